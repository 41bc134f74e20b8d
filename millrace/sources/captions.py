"""Caption sidecars: (key, text) tables in six formats.

Each parser works on a table (file_ix, value) of whole files or lines, so that it
also runs on captions that are already in a table. Of a key that occurs again the
last value holds, by file and then by place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flow import last_wins

JOINED = "<n>"


def _joined(cn, en):
    """Both languages with ``<n>`` between them, or the one that isn't empty."""
    return F.concat_ws(JOINED, F.when(cn != "", cn), F.when(en != "", en))


def parse_json(files: DataFrame, bilingual: bool = False) -> DataFrame:
    """{any: {uniqueKey, cnShortText[, enShortText]}}"""
    m = F.from_json("value", "MAP<STRING, STRUCT<uniqueKey: STRING, cnShortText: STRING, enShortText: STRING>>")
    rows = files.select("file_ix", F.posexplode(F.map_values(m)).alias("pos", "v"))
    text = F.when(F.col("v.enShortText").isNotNull(), F.concat("v.cnShortText", F.lit(JOINED), "v.enShortText")).otherwise(F.col("v.cnShortText")) if bilingual else F.col("v.cnShortText")
    return rows.select("file_ix", "pos", F.col("v.uniqueKey").alias("key"), text.alias("text"))


def parse_json_ks(files: DataFrame, bilingual: bool = False) -> DataFrame:
    """{RECORDS: [{uniqueKey, cnShortText[, enShortText]}]}; captions of one character
    and less are left out, with two languages only empty ones."""
    r = F.from_json("value", "RECORDS ARRAY<STRUCT<uniqueKey: STRING, cnShortText: STRING, enShortText: STRING>>")
    rows = files.select("file_ix", F.posexplode(r["RECORDS"]).alias("pos", "v"))
    if bilingual:
        text = _joined(F.coalesce("v.cnShortText", F.lit("")), F.coalesce("v.enShortText", F.lit("")))
        return rows.select("file_ix", "pos", F.col("v.uniqueKey").alias("key"), text.alias("text")).where("text <> ''")
    return rows.where(F.length("v.cnShortText") > 1).select("file_ix", "pos", F.col("v.uniqueKey").alias("key"), F.col("v.cnShortText").alias("text"))


def parse_dict(files: DataFrame, bilingual: bool = False) -> DataFrame:
    """{key: text}"""
    return files.select("file_ix", F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias("key", "text")).withColumn("pos", F.lit(0))


def parse_txt(lines: DataFrame, bilingual: bool = False) -> DataFrame:
    """key, two more characters, tab, text; another number of fields is an error."""
    f = F.split("value", "\t", -1)
    ok = F.when(F.size(f) == 2, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not two fields: "), "value")).cast("boolean"))
    return lines.where(ok).select("file_ix", F.col("pos"), F.substring(f[0], F.lit(1), F.greatest(F.length(f[0]) - 2, F.lit(0))).alias("key"), f[1].alias("text"))


def parse_tsv(lines: DataFrame, bilingual: bool = False, normalize_numeric_keys: bool = False) -> DataFrame:
    """Two columns under a header. Keys stay as written; with
    ``normalize_numeric_keys`` whole numbers lose leading zeros. An empty field is null, but empty where it is quoted."""
    # by default the escape's own escape is the character 0, which then is lost
    f = F.from_csv("value", F.lit("key STRING, text STRING"), {"sep": "\t", "escape": '"', "charToEscapeQuoteEscaping": '"'})
    key, text = (F.when(x.isNull() & quoted, "").otherwise(x) for x, quoted in ((f["key"], F.startswith("value", F.lit('""\t'))), (f["text"], F.endswith("value", F.lit('\t""')))))
    rows = lines.where("pos > 0").select("file_ix", "pos", key.alias("key"), text.alias("text"))
    return rows.withColumn("key", F.when(F.col("key").rlike(r"^\d+$"), F.expr("cast(cast(key as decimal(38)) as string)")).otherwise(F.col("key"))) if normalize_numeric_keys else rows


PARSERS = {"json": parse_json, "json_ks": parse_json_ks, "dict": parse_dict, "txt": parse_txt, "tsv": parse_tsv}


def parse_captions(table: DataFrame, mode: str, bilingual: bool = False) -> DataFrame:
    """(key, text) of a table (file_ix, value[, pos]), the last value of each key."""
    if mode not in PARSERS:
        raise ValueError(f"unknown caption format: {mode!r}")
    return last_wins(PARSERS[mode](table, bilingual), "key", "text", ["file_ix", "pos"])


def read_captions(spark: SparkSession, paths: Sequence[str] | None, mode: str, bilingual: bool = False, strict: bool = True) -> DataFrame:
    """(key, text) of caption files. Without files, or for an unknown format that
    isn't ``strict``, the table is empty."""
    if not paths or (mode not in PARSERS and not strict):
        return spark.createDataFrame([], "key string, text string")
    whole = mode in ("json", "json_ks", "dict")
    tables = []
    for k, path in enumerate(paths):
        if whole:
            tables.append(spark.read.text(path, wholetext=True).select(F.lit(k).alias("file_ix"), "value"))
        else:
            # one file's lines in order: a partition's lines keep their places
            lines = spark.read.text(path, lineSep="\n").select(F.lit(k).alias("file_ix"), "value", F.monotonically_increasing_id().alias("pos"))
            tables.append(lines)
    return parse_captions(reduce(DataFrame.unionByName, tables), mode, bilingual)
