"""Python data sources: ``zip``, ``tar``, ``rar`` and ``fixedbin``.

    register(spark)
    spark.read.format("zip").load("a.zip,b.zip")
    df.write.format("fixedbin").option("dtype", "int32").save(folder)

Archive rows are (file_ix, idx, full_filename, file_size, content, error). What
can't be read has a null content and its reason in ``error``; ``on_error`` =
``fail`` raises instead and ``drop`` leaves the row out. With
``include_content=false`` members are listed without being read.
"""

from __future__ import annotations

import tarfile
import uuid
import zipfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .files import fs_of, paths_of, size_of

MEMBERS = "file_ix int, idx bigint, full_filename string, file_size bigint, content binary, error string"
_MEMBERS = pa.schema([("file_ix", pa.int32()), ("idx", pa.int64()), ("full_filename", pa.string()), ("file_size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
#: Bytes of members in an Arrow batch.
BATCH = 8 << 20
DTYPES = {"int32": "<i4", "int64": "<i8", "float32": "<f4", "uint8": "u1", "bool": "?"}
_SQL = {"int32": "int", "int64": "bigint", "float32": "float", "uint8": "smallint", "bool": "boolean"}


@dataclass
class Part(InputPartition):
    path: str
    file_ix: int
    lo: int
    hi: int


class _Rows:
    """Archive rows gathered into Arrow batches of bounded size."""

    def __init__(self, options):
        self.on_error = options.get("on_error", "null")
        if self.on_error not in ("null", "drop", "fail"):
            raise ValueError(f"on_error is {self.on_error!r}; it can be null, drop or fail")
        self.content = str(options.get("include_content", "true")).lower() != "false"

    def batches(self, rows):
        held, size = [], 0
        for file_ix, idx, name, length, read in rows:
            content = error = None
            if self.content and read is not None:
                try:
                    content = read()
                except Exception as e:
                    if self.on_error == "fail":
                        raise
                    error = f"{type(e).__name__}: {e}"
                    if self.on_error == "drop":
                        continue
            held.append((file_ix, idx, name, length, content, error))
            size += len(content or b"") + 100
            if size >= BATCH:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MEMBERS)], schema=_MEMBERS)


class ZipReader(DataSourceReader):
    """Each task reads ``members_per_task`` members by the file's directory."""

    def __init__(self, options):
        self.paths, self.rows, self.per = paths_of(options["path"]), _Rows(options), int(options.get("members_per_task", 2000))

    def partitions(self):
        out = []
        for k, path in enumerate(self.paths):
            fs, at = fs_of(path)
            try:
                with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    n = len(z.infolist())
            except (zipfile.BadZipFile, pa.ArrowInvalid):  # a file shorter than a zip directory can be
                if self.rows.on_error == "fail":
                    raise
                n = -1
            out += [Part(path, k, lo, min(lo + self.per, n)) for lo in range(0, n, self.per)] if n >= 0 else [Part(path, k, 0, -1)] * (self.rows.on_error == "null")
        return out or [Part("", 0, 0, 0)]

    def read(self, part):
        if part.hi < 0:
            yield _Rows._batch([(part.file_ix, 0, part.path.rsplit("/", 1)[-1], 0, None, "BadZipFile: not a zip file")])
            return
        if not part.path:
            return
        fs, at = fs_of(part.path)
        with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            members = z.infolist()[part.lo : part.hi]
            yield from self.rows.batches((part.file_ix, part.lo + k, m.filename, m.file_size, None if m.is_dir() else (lambda m=m: z.read(m))) for k, m in enumerate(members))


class TarReader(DataSourceReader):
    """Regular files of plain tar archives. Headers are scanned once in planning
    by seeks; each task then reads its members' byte ranges."""

    def __init__(self, options):
        self.paths, self.rows, self.per = paths_of(options["path"]), _Rows(options), int(options.get("members_per_task", 2000))

    def partitions(self):
        out = []
        for k, path in enumerate(self.paths):
            fs, at = fs_of(path)
            with fs.open_input_file(at) as f, tarfile.TarFile(fileobj=f) as t:
                places = [(m.name, m.size, m.offset_data) for m in t if m.isfile()]
            for lo in range(0, len(places), self.per):
                p = Part(path, k, lo, min(lo + self.per, len(places)))
                p.places = places[p.lo : p.hi]
                out.append(p)
        return out or [Part("", 0, 0, 0)]

    def read(self, part):
        if not part.path:
            return
        fs, at = fs_of(part.path)
        with fs.open_input_file(at) as f:

            def get(offset, size):
                f.seek(offset)
                data = f.read(size)
                if len(data) < size:
                    raise EOFError("the member is cut off")
                return data

            yield from self.rows.batches((part.file_ix, part.lo + k, name, size, lambda o=offset, s=size: get(o, s)) for k, (name, size, offset) in enumerate(part.places))


class RarReader(DataSourceReader):
    """Members of rar archives, if a module ``rarfile`` is installed; one task a file."""

    def __init__(self, options):
        try:
            import rarfile  # noqa: F401
        except ImportError:
            raise RuntimeError("reading rar needs the module rarfile and an unrar program on every node") from None
        self.paths, self.rows = paths_of(options["path"]), _Rows(options)

    def partitions(self):
        return [Part(p, k, 0, 0) for k, p in enumerate(self.paths)]

    def read(self, part):
        import rarfile

        fs, at = fs_of(part.path)
        with fs.open_input_file(at) as f, rarfile.RarFile(f) as r:
            members = [m for m in r.infolist() if not m.is_dir()]
            yield from self.rows.batches((part.file_ix, k, m.filename, m.file_size, lambda m=m: r.read(m)) for k, m in enumerate(members))


class _Archive(DataSource):
    def schema(self):
        return MEMBERS


class ZipSource(_Archive):
    """Every entry, directories included (without content)."""

    @classmethod
    def name(cls):
        return "zip"

    def reader(self, schema):
        return ZipReader(self.options)


class TarSource(_Archive):
    @classmethod
    def name(cls):
        return "tar"

    def reader(self, schema):
        return TarReader(self.options)

    def writer(self, schema, overwrite):
        return TarWriter(self.options, overwrite)


class RarSource(_Archive):
    @classmethod
    def name(cls):
        return "rar"

    def reader(self, schema):
        return RarReader(self.options)


class FixedReader(DataSourceReader):
    """Byte ranges of whole samples; a partial sample at the end is dropped."""

    def __init__(self, options):
        self.paths = paths_of(options["path"])
        self.dtype, self.width = options.get("dtype", "int32"), int(options["length_per_sample"])
        self.bytes = np.dtype(DTYPES[self.dtype]).itemsize * self.width
        self.per = max(1, int(options.get("bytes_per_task", 64 << 20)) // self.bytes)

    def partitions(self):
        out, base = [], 0
        for k, path in enumerate(self.paths):
            n = size_of(path) // self.bytes
            for lo in range(0, n, self.per):
                p = Part(path, k, lo, min(lo + self.per, n))
                p.base = base
                out.append(p)
            base += n
        return out or [Part("", 0, 0, 0)]

    def read(self, part):
        if not part.path:
            return
        fs, at = fs_of(part.path)
        step = max(1, (4 << 20) // self.bytes)
        with fs.open_input_file(at) as f:
            f.seek(part.lo * self.bytes)
            for lo in range(part.lo, part.hi, step):
                n = min(step, part.hi - lo)
                x = np.frombuffer(f.read(n * self.bytes), DTYPES[self.dtype])
                if self.dtype == "uint8":
                    x = x.astype(np.int16)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.width), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + n) + part.base), pa.array(np.full(n, part.file_ix, np.int32)), rows], names=["sample_id", "file_ix", "sample"])


def cast_wrapping(x: np.ndarray, dtype: str) -> np.ndarray:
    """A C-style cast: integers wrap, everything but 0 is true."""
    return x.astype(DTYPES[dtype], casting="unsafe")


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class _Commit:
    """Parts appear under their names when the whole job has ended well."""

    def _begin(self, options, overwrite, suffix):
        self.path, self.prefix, self.suffix, self.overwrite = options["path"], options.get("prefix", "part"), suffix, overwrite

    def _part(self):
        from pyspark import TaskContext

        fs, at = fs_of(self.path)
        fs.create_dir(at, recursive=True)
        k = TaskContext.get().partitionId()
        return fs, Written(f"{at}/.{uuid.uuid4().hex}", f"{at}/{self.prefix}_{k:05d}{self.suffix}")

    def commit(self, messages):
        fs, at = fs_of(self.path)
        fs.create_dir(at, recursive=True)
        if self.overwrite:
            import pyarrow.fs as pafs

            keep = {m.temporary for m in messages if m}
            for f in fs.get_file_info(pafs.FileSelector(at)):
                if f.type == pafs.FileType.File and f.path not in keep:
                    fs.delete_file(f.path)
        for m in messages:
            if m:
                fs.move(m.temporary, m.final)

    def abort(self, messages):
        fs, _ = fs_of(self.path)
        for m in messages:
            if m:
                fs.delete_file(m.temporary)


class FixedWriter(_Commit, DataSourceArrowWriter):
    def __init__(self, options, schema, overwrite):
        self._begin(options, overwrite, options.get("suffix", ".samples"))
        self.dtype = options.get("dtype", "int32")
        if self.dtype not in DTYPES:
            raise ValueError(f"dtype is {self.dtype!r}; it can be {', '.join(DTYPES)}")
        arrays = [k for k, f in enumerate(schema.fields) if f.dataType.typeName() == "array"]
        if len(arrays) != 1:
            raise ValueError("fixedbin writes one array column")
        self.column = arrays[0]

    def write(self, iterator):
        fs, message = self._part()
        with fs.open_output_stream(message.temporary, compression=None) as f:
            for batch in iterator:
                x = batch.column(self.column).flatten().to_numpy(zero_copy_only=False)
                f.write(cast_wrapping(x, self.dtype).tobytes())
        return message


class TarWriter(_Commit, DataSourceWriter):
    """Members from the columns full_filename and content; ``mtime`` is an option, 0
    by default, so that equal rows make equal files."""

    def __init__(self, options, overwrite):
        self._begin(options, overwrite, options.get("suffix", ".tar"))
        self.mtime = int(options.get("mtime", 0))

    def write(self, iterator):
        import io

        fs, message = self._part()
        with fs.open_output_stream(message.temporary, compression=None) as f, tarfile.TarFile(fileobj=f, mode="w") as t:
            for row in iterator:
                if row["content"] is None:
                    continue
                info = tarfile.TarInfo(row["full_filename"])
                info.size, info.mtime = len(row["content"]), self.mtime
                t.addfile(info, io.BytesIO(row["content"]))
        return message


class FixedSource(DataSource):
    """Samples of ``length_per_sample`` values of ``dtype``, back to back."""

    @classmethod
    def name(cls):
        return "fixedbin"

    def schema(self):
        return f"sample_id bigint, file_ix int, sample array<{_SQL[self.options.get('dtype', 'int32')]}>"

    def reader(self, schema):
        return FixedReader(self.options)

    def writer(self, schema, overwrite):
        return FixedWriter(self.options, schema, overwrite)


SOURCES = {s.name(): s for s in (ZipSource, TarSource, RarSource, FixedSource)}


def register(spark: SparkSession) -> SparkSession:
    for source in SOURCES.values():
        spark.dataSource.register(source)
    return spark
