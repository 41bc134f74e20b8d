"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.ship import ship

from . import bpe, decontam, langid, line_dedup, ngram_join, quality_mil, quality_rules, toxicity, url_filter, warc

#: Domain names whose pages are listed, under any host and top-level domain.
LISTED = "ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm"


def _table(spark, sf_dir, name):
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    return warc.pages_round_trip(_table(spark, sf_dir, "pages"))


def op4_quality_rules(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    forest = quality_rules.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.score(docs.select("doc_id", "text"), forest).select("doc_id", "quality_score", "keep")


def op5_url_filter(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url").withColumn("key", url_filter.url_key("url"))
    listed = pages.where(url_filter.url_host("key").rlike(rf"(^|\.)({LISTED})\.example\.(com|net|org)$")).select("key").distinct()
    return url_filter.mark_listed(pages, "key", listed).select("page_id", "url", "listed")


def op6_decontamination(spark, sf_dir):
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_bpe(spark, sf_dir):
    return bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "tokens", "n_tokens", "round_trip")


def op8_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs.select("doc_id", "text"), langid.fit(docs)).select("doc_id", "language", "language_margin")


def op9_quality_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    net = quality_mil.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_mil.score(docs.select("doc_id", "text"), net).drop("text")


def op10_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", "toxic_score", "toxic")


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_ngram_jaccard_join, op3_warc, op4_quality_rules, op5_url_filter, op6_decontamination, op7_bpe, op8_language_id, op9_quality_classifier, op10_toxicity)
}

_WORDS = r"regexp_extract_all(lower(text), '(?:[0-9a-z]|[^\x{00}-\x{bf}\x{2000}-\x{207f}\x{3000}-\x{303f}])+')"

SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[pos + 1 : pos + {ngram_join.N}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - {ngram_join.N - 1}, 1))) AS pos FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE o >= {ngram_join.THRESHOLD} * (x.n + y.n - o) - 1e-9),
        c(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
        k AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
        SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM (SELECT a AS doc_id, min(b) AS class_id FROM c GROUP BY a) LEFT JOIN k ON k.a = doc_id""",
    "op3_warc": "SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS html_bytes, md5(html) AS html_md5 FROM pages",
    "op5_url_filter": rf"SELECT page_id, url, regexp_matches(lower(trim(url)), '^([a-z][a-z0-9+.-]*://)?([^/:?#]*\.)?({LISTED})\.example\.(com|net|org)([/:?#]|$)') AS listed FROM pages",
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        dg AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + {decontam.N}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - {decontam.N - 1})) AS pos FROM d WHERE len(w) >= {decontam.N})),
        bg AS (SELECT item_id, win, array_to_string(w[pos + 1 : pos + {decontam.N}], ' ') AS g FROM (SELECT item_id, w, len(w) - {decontam.N - 1} AS win, unnest(range(len(w) - {decontam.N - 1})) AS pos FROM b WHERE len(w) >= {decontam.N})),
        items AS (SELECT item_id, max(win) AS win, count(DISTINCT g) AS n FROM bg GROUP BY item_id),
        hits AS (SELECT DISTINCT doc_id, item_id, pos, dg.g FROM dg JOIN bg USING (g)),
        windows AS (SELECT a.doc_id, a.item_id, a.pos, count(DISTINCT h.g) AS got FROM hits a JOIN items USING (item_id)
          JOIN hits h ON h.doc_id = a.doc_id AND h.item_id = a.item_id AND h.pos >= a.pos AND h.pos < a.pos + win GROUP BY ALL),
        best AS (SELECT doc_id, item_id, max(got) AS got, min_by(pos, struct_pack(a := -got, b := pos)) AS first_pos FROM windows GROUP BY ALL)
        SELECT doc_id, item_id, CAST(got AS DOUBLE) / n AS containment, CAST(first_pos AS INTEGER) AS at_word
        FROM best JOIN items USING (item_id) WHERE got >= ceil(n * {decontam.THRESHOLD} - 1e-9)""",
}
