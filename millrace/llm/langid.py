"""Language identification, words first, then shorter and shorter n-grams.

A known word scores by its log frequency in each language. An unseen word backs
off to its character n-grams of the greatest length (5 down to 1, with word
ends) of which at least one is known, at a penalty for each step. A text's
language is the one with the greatest sum over all of its words.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .store import fits, keep

#: The fit reads at most so many labelled documents of each language.
PER_LANGUAGE = 2000
#: The model keeps the most frequent words and n-grams of each language, so its size is bounded by the
#: number of languages, and no language's words push out another's.
MOST_WORDS, MOST_GRAMS = 100_000, 50_000
LONGEST = 5
PENALTY = 0.5


@dataclass(frozen=True)
class Model:
    """Sorted keys and a row of log frequencies by language for each."""

    languages: list[str]
    words: np.ndarray
    word_scores: np.ndarray
    grams: np.ndarray
    gram_scores: np.ndarray


def word_grams(data: np.ndarray, start: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of all n-grams of code points of the words with an end mark on
    each side; n-grams that are longer than the marked word don't exist."""
    total = int(size.sum()) + 2 * len(size)
    first = np.cumsum(size + 2) - (size + 2)
    marked = np.full(total, 32, np.uint8)
    body = np.repeat(first + 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    marked[body] = data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    word = np.repeat(np.arange(len(size)), size + 2)
    lead = np.flatnonzero((marked & 0xC0) != 0x80)  # first bytes of code points
    word_of = word[lead]
    code = np.zeros(len(lead), np.uint64)
    width = np.diff(np.append(lead, total))
    for k in range(4):
        has = width > k
        code[has] = code[has] << np.uint64(8) | marked[lead[has] + k].astype(np.uint64)
    if len(lead) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    last = len(lead) - n + 1
    same = word_of[:last] == word_of[n - 1 :]
    h = np.full(last, n, np.uint64)
    for k in range(n):
        h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + code[k : k + last])
    return h[same], word_of[:last][same]


def _counts(it):
    """(kind, language, key, n) of words (kind 0) and n-grams (kind n)."""
    for batch, data, offsets in K.batches(it):
        lang = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.int64)
        words = K.Words(data, offsets)
        if not len(words.hash):
            continue
        parts = [(0, words.hash, lang[words.unit])]
        for n in range(1, LONGEST + 1):
            h, w = word_grams(data, words.start, words.size, n)
            parts.append((n, h, lang[words.unit[w]]))
        for kind, h, of in parts:
            for k in np.unique(of):
                key, count = np.unique(h[of == k], return_counts=True)
                yield pa.RecordBatch.from_pydict({"kind": np.full(len(key), kind, np.int32), "lang": np.full(len(key), k, np.int32), "key": key.view(np.int64), "n": count})


def spark_map(of: dict[str, tuple[int, float]]) -> dict:
    """Columns k and part of a row's ``lang``."""
    maps = [F.create_map(*[F.lit(x) for name, v in of.items() for x in (name, v[at])]) for at in (0, 1)]
    return {"k": maps[0][F.col("lang")], "part": maps[1][F.col("lang")]}


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS) -> Model:
    """A model from at most ``per_language`` documents of each value of ``lang``,
    those with the least hashes of their ids, and from at most ``most_words``
    words and ``most_grams`` n-grams of each language, the most frequent ones.

    Rows without a language, doc_id or text are left out. A doc_id that is in two
    languages' samples counts for the one that comes first in alphabetical order;
    rows that repeat a doc_id within a language all count. Without languages the model has none.
    """
    some = docs.where("lang is not null and doc_id is not null and text is not null")
    sizes = {r[0]: r[1] for r in some.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.empty(0, np.uint64), np.empty((0, 0)), np.empty(0, np.uint64), np.empty((0, 0)))
    # ids below a hash that about twice as many are below as are wanted, then the least of those
    parts = spark_map({name: (k, min(1.0, 2 * per_language / sizes[name])) for k, name in enumerate(languages)})
    below = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < parts["part"] * (1 << 40)
    few = some.select("doc_id", parts["k"].alias("k"), below.alias("below")).where("below").select("doc_id", "k").distinct()
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id"))
    picked = few.withColumn("rank", rank).where(F.col("rank") <= per_language)
    picked = keep(picked.groupBy("doc_id").agg(F.min("k").alias("k")), "language-sample")
    side = F.broadcast(picked) if fits(picked, 16) else picked
    counts = some.select("doc_id", "text", parts["k"].alias("own")).join(side, "doc_id").where("own = k").select("text", F.col("k").cast("int")).mapInArrow(_counts, "kind int, lang int, key long, n long")
    counts = keep(counts.groupBy("kind", "lang", "key").agg(F.sum("n").alias("n")), "language-counts")

    def top(kinds, most):
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "kind", "key"))
        some = counts.where(F.col("kind").isin(kinds))
        total = some.withColumn("rank", rank).where(F.col("rank") <= most).select("kind", "key").distinct()
        rows = some.join(total, ["kind", "key"]).select("key", "lang", "n").toArrow()
        key, at = np.unique(rows.column("key").to_numpy().view(np.uint64), return_inverse=True)
        n = np.zeros((len(key), len(languages)))
        np.add.at(n, (at, rows.column("lang").to_numpy()), rows.column("n").to_numpy())
        return key, n

    sums = {(r["kind"], r["lang"]): r["n"] for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    words, n = top([0], most_words)
    size = np.array([[sums.get((0, k), 0) for k in range(len(languages))]], float)
    word_scores = np.log((n + 0.1) / (size + 0.1 * max(1, len(words))))
    grams, n = top(list(range(1, LONGEST + 1)), most_grams)
    size = np.array([[sum(sums.get((g, k), 0) for g in range(1, LONGEST + 1)) for k in range(len(languages))]], float)
    gram_scores = np.log((n + 0.1) / (size + 0.1 * max(1, len(grams))))
    return Model(languages, words, word_scores.astype(np.float32), grams, gram_scores.astype(np.float32))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key is among the sorted keys; -1 if it isn't."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def word_scores(model: Model, data, words: K.Words) -> np.ndarray:
    """A row of scores by language for each word."""
    key, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
    out = np.zeros((len(key), len(model.languages)), np.float32)
    at = _find(model.words, key)
    out[at >= 0] = model.word_scores[at[at >= 0]]
    open_ = np.flatnonzero(at < 0)
    for n in range(LONGEST, 0, -1):
        if not len(open_):
            break
        h, w = word_grams(data, words.start[first[open_]], words.size[first[open_]], n)
        at = _find(model.grams, h)
        h, w, at = h[at >= 0], w[at >= 0], at[at >= 0]
        count = np.bincount(w, minlength=len(open_))
        for k in range(len(model.languages)):
            total = np.bincount(w, weights=model.gram_scores[at, k], minlength=len(open_))
            some = count > 0
            out[open_[some], k] = total[some] / count[some] * PENALTY ** (LONGEST - n)
        open_ = open_[count == 0]
    return out[back]


def _identify(model: Model):
    def run(it):
        for batch, data, offsets in K.batches(it):
            words = K.Words(data, offsets)
            docs, n = len(offsets) - 1, len(model.languages)
            total = np.zeros((docs, max(n, 1)))
            if n and len(words.hash):
                scores = word_scores(model, data, words)
                for k in range(n):
                    total[:, k] = np.bincount(words.unit, weights=scores[:, k], minlength=docs)
            best = total.argmax(axis=1)
            count = np.diff(words.first)
            none = (count == 0) | (n == 0)
            rest = np.where(np.arange(total.shape[1])[None, :] == best[:, None], -np.inf, total).max(axis=1)
            margin = np.where(np.isfinite(rest), total.max(axis=1) - rest, 0.0) / np.maximum(count, 1)
            names = [None if e else model.languages[b] for b, e in zip(best, none)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(margin, mask=none)], names=[*batch.schema.names, "language", "language_margin"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``language`` and ``language_margin``: the lead over the second
    best language in log frequency a word.

    Defined cases: null, empty and wordless texts, and all texts for a model
    without languages, have null results; of equal scores the first language in
    alphabetical order holds; repeated rows stay; columns named like the results
    are replaced. An empty table gives an empty table.
    """
    own = docs.drop("language", "language_margin")
    return own.mapInArrow(_identify(model), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", language string, language_margin double")
