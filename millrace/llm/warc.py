"""Normalising monolithic gzip WARC files to one gzip member per record.

A WARC file that was compressed as one stream has no place to seek to. Each such
file is read by one task as a stream: it is inflated once in blocks, each record
is written as a gzip member of its own, and a sidecar index tells every
record's offset and length in the new file. Memory is one block and one record's
headers; payloads pass through. Files appear under their final name only when
complete, so a lost or repeated task leaves no half file.
"""

import hashlib
import re
import uuid
import zlib
from datetime import datetime, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import folder, keep

BLOCK = 1 << 20
INDEX = "source string, file string, n long, offset long, length long, type string, uri string, record_id string, payload_bytes long, payload_md5 string"
_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _Inflated:
    """Bytes of a gzip stream (of one or more members) with line and block reads."""

    def __init__(self, raw):
        self.raw, self.z, self.held, self.at, self.rest, self.began = raw, zlib.decompressobj(31), b"", 0, b"", False

    def _more(self) -> bool:
        while True:
            data = self.rest or self.raw.read(BLOCK)
            self.rest = b""
            if not data:
                if not self.z.eof and self.began:
                    raise EOFError("the gzip stream is cut off")
                return False
            self.began = True
            if self.z.eof:
                data = data.lstrip(b"\0")
                if not data:
                    continue
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(data, BLOCK)
            self.rest = self.z.unconsumed_tail or self.z.unused_data
            if out:
                self.held = self.held[self.at :] + out
                self.at = 0
                return True

    def line(self) -> bytes:
        """Up to and with the next line feed; empty at the end."""
        seen = 0
        while True:
            k = self.held.find(b"\n", self.at + seen)
            if k >= 0:
                out = self.held[self.at : k + 1]
                self.at = k + 1
                return out
            seen = len(self.held) - self.at
            if not self._more():
                out, self.at = self.held[self.at :], len(self.held)
                return out

    def blocks(self, n: int):
        """The next ``n`` bytes in blocks."""
        while n:
            if self.at == len(self.held) and not self._more():
                raise EOFError("a record is cut off")
            out = self.held[self.at : self.at + n]
            self.at += len(out)
            n -= len(out)
            yield out


def normalise_file(raw, out, level: int = 6):
    """Copy records from a gzip stream to members of ``out``; yields index rows."""
    src, offset, n = _Inflated(raw), 0, 0
    while True:
        line = src.line()
        while line in (b"\r\n", b"\n"):
            line = src.line()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"record {n} doesn't begin with WARC/")
        head, fields = [line], {}
        while (line := src.line()) not in (b"\r\n", b"\n", b""):
            head.append(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        head.append(b"\r\n")
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"record {n} has no Content-Length")
        size = int(fields["content-length"])
        z, length, digest, http, held, body = zlib.compressobj(level, zlib.DEFLATED, 31), 0, hashlib.md5(), fields.get("content-type", "").startswith("application/http"), b"", 0
        data = z.compress(b"".join(head))
        out.write(data)
        length += len(data)
        for part in src.blocks(size):
            data = z.compress(part)
            out.write(data)
            length += len(data)
            if http:  # the payload begins after the HTTP header
                held += part
                k = held.find(b"\r\n\r\n")
                if k < 0:
                    continue
                part, http, held = held[k + 4 :], False, b""
            digest.update(part)
            body += len(part)
        if http:
            digest.update(held)
            body += len(held)
        data = z.compress(b"\r\n\r\n") + z.flush()
        out.write(data)
        length += len(data)
        yield n, offset, length, fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-record-id"), body, digest.hexdigest()
        offset += length
        n += 1


def member_name(path: str) -> str:
    """The new file's name: the old one's with a hash of the whole path, so that files of one name in two folders stay apart."""
    base = path.rstrip("/").rsplit("/", 1)[-1]
    return f"{hashlib.md5(path.encode()).hexdigest()[:16]}-{base}"


def _normalise(target, level):
    def run(it):
        for batch in it:
            for source in batch.column(0).to_pylist():
                fs, path = open_fs(source)
                to_fs, to = open_fs(target)
                to_fs.create_dir(to, recursive=True)
                base = member_name(path)
                final, part = f"{to}/{base}", f"{to}/.{base}.{uuid.uuid4().hex}"
                rows = []
                with fs.open_input_stream(path, compression=None) as raw, to_fs.open_output_stream(part, compression=None) as out:
                    for row in normalise_file(raw, out, level):
                        rows.append((source, f"{target}/{base}", *row))
                index = pa.Table.from_pylist([dict(zip(_NAMES, r)) for r in rows], schema=_ARROW)
                pq.write_table(index, f"{part}.idx", filesystem=to_fs, compression="zstd")
                to_fs.move(part, final)
                to_fs.move(f"{part}.idx", f"{final}.idx.parquet")
                for b in index.to_batches(max_chunksize=1 << 14):
                    yield b

    return run


_ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64()}[x.split()[1]]) for x in INDEX.split(", ")])


def normalise(spark: SparkSession, sources: list[str], target: str, level: int = 6) -> DataFrame:
    """Rewrite each gzip WARC file of ``sources`` below ``target``; returns the index.

    Each file gets a sidecar ``<name>.idx.parquet`` with the same rows. A file is
    one task, as a gzip stream can't be split; files are the unit of parallelism.

    Defined cases: files that already have several members, zero padding between
    members, and files without a record are read the same way; a stream or a
    record that is cut off, a record that doesn't begin with WARC/ and one
    without a Content-Length are errors, and nothing appears under the final
    name. Records keep their bytes, headers of repeated and unknown fields
    included. New names hold a hash of the source's path; a source that is given
    twice is an error.
    """
    if len(set(sources)) < len(sources):
        raise ValueError("a source is given twice")
    if not sources:
        return spark.createDataFrame([], INDEX)
    files = spark.createDataFrame([(s,) for s in sources], "source string").repartition(len(sources))
    return keep(files.mapInArrow(_normalise(target, level), INDEX), "warc-index")


def _record(page_id, url, html) -> bytes:
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode()
    head = [b"WARC/1.0", b"WARC-Type: response", b"WARC-Record-ID: <urn:page:%d>" % page_id, b"WARC-Date: " + datetime.fromtimestamp(0, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ").encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + (url if "\n" not in url and "\r" not in url else quote(url)).encode())
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def _write(target, level):
    def run(it):
        from pyspark import TaskContext

        fs, path = open_fs(target)
        fs.create_dir(path, recursive=True)
        part = f"{path}/.{uuid.uuid4().hex}"
        name = f"{path}/pages-{TaskContext.get().partitionId():05d}.warc.gz"
        z, n = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        with fs.open_output_stream(part, compression=None) as out:
            for batch in it:
                for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    if row[0] is None:
                        continue
                    out.write(z.compress(_record(*row)))
                    n += 1
            out.write(z.flush())
        fs.move(part, name)
        yield pa.RecordBatch.from_pydict({"file": [f"{target}/{name.rsplit('/', 1)[1]}"], "n": pa.array([n], pa.int64())})

    return run


def write_monolithic(pages: DataFrame, target: str, level: int = 6) -> list[str]:
    """Write pages as WARC files that are one gzip stream each, one per partition."""
    done = keep(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_write(target, level), "file string, n long"), "warc-files")
    return [r["file"] for r in done.orderBy("file").collect()]


def _read(it):
    for batch in it:
        rows, fs, path, f = batch.to_pylist(), None, None, None
        out = []
        for row in rows:
            if row["file"] != path:
                if f is not None:
                    f.close()
                path = row["file"]
                fs, at = open_fs(path)
                f = fs.open_input_file(at)
            f.seek(row["offset"])
            record = zlib.decompress(f.read(row["length"]), 31)
            out.append(record)
        if f is not None:
            f.close()
        yield pa.RecordBatch.from_pydict({name: pa.array([r[name] for r in rows], pa.string()) for name in ("type", "uri", "record_id")} | {"payload": pa.array([payload(r) for r in out], pa.binary())})


def payload(record: bytes) -> bytes:
    """A record's block; of an HTTP message what follows its header, as for the index's digest."""
    end = re.search(rb"\r?\n\r?\n", record)
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in record[: end.start()].split(b"\n")))
    block = record[end.end() : end.end() + int(fields[b"content-length"])]
    if not fields.get(b"content-type", b"").startswith(b"application/http"):
        return block
    head, blank, body = block.partition(b"\r\n\r\n")
    return body if blank else head


def read_records(index: DataFrame) -> DataFrame:
    """(type, uri, record_id, payload) of the index's records of any type, each by one seek; payloads are bytes."""
    return index.select("file", "offset", "length", "type", "uri", "record_id").mapInArrow(_read, "type string, uri string, record_id string, payload binary")


def pages_round_trip(pages: DataFrame) -> DataFrame:
    """Pages through a monolithic file, its normalised form, and a seek per record.

    (page_id, url, html_bytes, html_md5) as read back from the new members by
    their offsets. A null html comes back empty; a row with a null page_id has no
    record; repeated rows have a record each; other columns are ignored.
    """
    spark = pages.sparkSession
    base = folder(spark, "warc")
    index = normalise(spark, write_monolithic(pages, f"{base}/monolithic"), f"{base}/members")
    back = read_records(index)
    return back.select(F.regexp_extract("record_id", r"<urn:page:(-?\d+)>", 1).cast("long").alias("page_id"), F.col("uri").alias("url"), F.octet_length("payload").cast("long").alias("html_bytes"), F.md5("payload").alias("html_md5"))
