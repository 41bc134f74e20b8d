"""Toxicity by FTRL-proximal logistic regression on hashed word features.

Features are the words, word pairs, and pairs with one or two words between
them, hashed to 2^20 coordinates and present or absent in a document. Each
coordinate has a learning rate of its own; L1 leaves few weights, and only
those are sent to the executors. The whole text counts.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .samples import labelled, skew
from .store import keep

BITS = 20
#: The most labelled documents of each class that the fit reads, and the most bytes of their features (4 bytes each).
PER_CLASS, CLASS_BYTES = 6000, 24 << 20


@dataclass(frozen=True)
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float
    threshold: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weight
        return out


def features(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, unit) of all features, with repeats."""
    parts = [(words.hash, words.unit)] + [words.pairs(gap) for gap in (0, 1, 2)]
    return np.concatenate([(K.mix(h) >> K.U64(64 - BITS)).astype(np.int64) for h, _ in parts]), np.concatenate([u for _, u in parts])


def _examples(it):
    for batch, data, offsets in K.batches(it):
        at, unit = features(K.Words(data, offsets))
        both = np.unique(unit << BITS | at)
        ends = np.searchsorted(both, np.arange(len(offsets)) << BITS)
        x = (both & ((1 << BITS) - 1)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "y": batch.column(2), "x": pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())})


def ftrl(examples: list[tuple[np.ndarray, int]], alpha=1.0, beta=1.0, l1=8.0, l2=1.0, epochs=6, seed=5, negatives=1.0) -> Model:
    """Fit on all but every fifth example; those set the threshold."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        if i[-1] == size:  # the bias isn't penalised
            w[-1] = -zi[-1] / ((beta + np.sqrt(n[size])) / alpha)
        return w

    fit, held = [e for k, e in enumerate(examples) if k % 5], examples[::5]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            x, y = fit[k]
            i = np.append(x, size)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = p - y
            ni = n[i]
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] += g - s * w
            n[i] = ni + g * g
    at = np.flatnonzero(np.abs(z[:size]) > l1)
    w, bias = weights(np.append(at, size)), 0.0
    w, bias = w[:-1].astype(np.float32), float(w[-1])
    dense = np.zeros(size, np.float32)
    dense[at] = w
    return Model(at, w, bias, best_threshold(np.array([dense[x].sum() + bias for x, _ in held]), np.array([y for _, y in held]), negatives))


def best_threshold(score: np.ndarray, y: np.ndarray, negatives: float = 1.0) -> float:
    """The middle of the widest gap among the cuts of the best F1; 0 without positives.

    Each negative stands for ``negatives`` of them, as the sample is balanced.
    """
    if not len(y) or not y.any() or y.all():
        return 0.0
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (hit + negatives * (np.arange(1, len(y) + 1) - hit) + y.sum())
    s = np.append(score[order], score.min() - 1)
    f1[s[:-1] == s[1:]] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax(s[best] - s[best + 1])]
    return float((s[k] + s[k + 1]) / 2)


def _fitted(negatives: float):
    """One row with the model of a task's examples; none without examples."""

    def run(it):
        found = sorted(row for batch in it for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "x", "y"))))
        if found:
            model = ftrl([(np.frombuffer(x, np.int32), y) for _, x, y in found], negatives=negatives)
            yield pa.RecordBatch.from_pydict({"at": pa.array([model.index.tobytes()], pa.binary()), "weight": pa.array([model.weight.tobytes()], pa.binary()), "bias": [model.bias], "threshold": [model.threshold]})
        K.release()

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Model:
    """A model from at most ``per_class`` labelled documents of each class, and of
    those as many in the order of their ids' hashes as have ``class_bytes`` of
    features (one at least).

    Null labels, ids and texts are left out; of repeated labels the largest
    holds; each row of a repeated doc_id is an example. Labels of one class only,
    or none, give a model whose threshold is 0; without examples every text
    scores 0 and none is toxic. The rows' order doesn't matter.
    """
    rows = keep(labelled(docs, labels, "toxic", per_class).mapInArrow(_examples, "doc_id long, y int, x binary"), "toxic-examples")
    by = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x"))
    before = F.coalesce(F.sum(F.octet_length("x")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most per_class ids a class, each with its rows
    some = rows.withColumn("before", before).where((F.col("before") == 0) | (F.col("before") + F.octet_length("x") <= class_bytes)).select("doc_id", "y", "x")
    # one task's work, so that neither the examples nor the coordinates take the driver's memory; written, so that it reads no more than these
    model = keep(some, "toxic-sample").coalesce(1).mapInArrow(_fitted(skew(labels, "toxic", per_class, rare=1)), "at binary, weight binary, bias double, threshold double").first()
    return ftrl([]) if model is None else Model(np.frombuffer(model["at"], np.int64), np.frombuffer(model["weight"], np.float32), model["bias"], model["threshold"])


def _scores(model: Model):
    def run(it):
        dense = model.dense()
        some = dense != 0
        for batch, data, offsets in K.batches(it):
            at, unit = features(K.Words(data, offsets))
            used = some[at]
            both = np.unique(unit[used] << BITS | at[used])
            score = np.bincount(both >> BITS, weights=dense[both & ((1 << BITS) - 1)], minlength=len(offsets) - 1) + model.bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(score > model.threshold)], names=[*batch.schema.names, "toxic_score", "toxic"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxic_score`` (log odds) and ``toxic``.

    Defined cases: null, empty and wordless texts score the bias; repeated rows
    each get the same score; columns of docs named like the two results are
    replaced. An empty table gives an empty table.
    """
    own = docs.drop("toxic_score", "toxic")
    return own.mapInArrow(_scores(model), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", toxic_score double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that the fitted model doesn't call toxic, with their columns."""
    return score(docs, fit(docs, labels, per_class)).where(~F.col("toxic")).select(*docs.columns)
