"""The pipeline against the same steps by brute force."""

import random

import corpus_pipeline as P
from millrace.llm import bpe, decontam, line_dedup, ngram_join

from .test_documents import brute_classes, brute_leaks, brute_lines, edited, sentence

BAD = ["fizzbad", "grumbad", "hexbad"]


def tables(spark, folder):
    r = random.Random(21)
    items = [(k, sentence(r, 30)) for k in range(4)]
    clean = ["\n".join(sentence(r, r.choice([5, 20, 40])) for _ in range(3)) for _ in range(70)]
    toxic = [edited(r, sentence(r, 60), 4) + " " + " ".join(r.sample(BAD, 2)) + " " + sentence(r, 20) for _ in range(30)]
    copies = [edited(r, clean[k], 1) for k in range(8)] + clean[8:14]
    lines = [clean[k].split("\n")[2] + "\n" + sentence(r, 40) for k in range(20, 26)]
    leaks = [sentence(r, 20) + " " + x + " " + sentence(r, 20) for _, x in items]
    texts = clean + toxic + copies + lines + leaks + ["", None, "...", "é漢😀 " * 9]
    kind = [0] * len(clean) + [1] * len(toxic) + [0] * (len(texts) - len(clean) - len(toxic))
    order = list(range(len(texts)))
    r.shuffle(order)
    docs = [(d, texts[k], "en", "s", len(texts[k] or "")) for d, k in enumerate(order)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, kind[k]) for d, k in enumerate(order) if k < 100 and d % 7], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return [(d[0], d[1]) for d in docs], items, {d for d, k in enumerate(order) if kind[k]}


def test_pipeline(spark, tmp_path):
    docs, items, toxic = tables(spark, str(tmp_path))
    docs = [x for x in docs if x[0] not in toxic]
    gone, _ = brute_lines(docs)
    after = []
    for d, t in docs:
        if t is not None and any(x == d for x, _ in gone):
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
            if not t.strip():
                continue
        after.append((d, t))
    kept = {d for d, least, _ in brute_classes(after, ngram_join.N, ngram_join.THRESHOLD) if d == least}
    after = [(d, t) for d, t in after if d in kept]
    leaked = {d for d, _ in brute_leaks(after, items, decontam.N, decontam.THRESHOLD)}
    want = {d: t for d, t in after if d not in leaked}
    rows = P.run(spark, str(tmp_path)).collect()
    codec = bpe.codec(bpe.VOCABULARY)
    assert {r.doc_id: None if r.tokens is None else codec.text(r.tokens) for r in rows} == want
    assert len(rows) == len(want) and len(leaked) >= 4 and len(gone) > 20


def test_stages_keep_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == P.COLUMNS
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert line_dedup.SIMILARITY == 0.9 and len(P.STAGES) == 5
