"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from the bytes of whole batches. Trees are grown on histograms
with logistic loss; for features with a direction, a split counts only if its
children's values are in that order, and both subtrees stay on their side of the
middle, so the score is monotonic in the feature. The trees are flattened into
arrays of nodes, and a batch descends all of them a level at a time.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .samples import labelled, skew
from .toxicity import best_threshold

PER_CLASS = 4000
#: Each statistic and the direction in which more of it makes quality better.
FEATURES = {
    "words": 0, "word_bytes": 0, "letters": 0, "upper": -1, "digits": 0, "symbols": -1, "punctuation": 0, "non_ascii": 0,
    "spaces": 0, "lines": 0, "line_words": 0, "distinct_words": 1, "repeated_lines": -1, "short_words": 0, "bars": -1,
}
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
for _c in b"#$%&*+<=>@\\^_`{}~/!":
    _CLASS[_c] = 4
for _c in b".,;:?'\"()-[]":
    _CLASS[_c] = 5
for _c in b" \t\r\n\x0b\x0c":
    _CLASS[_c] = 6
_CLASS[ord("|")] = 7
_CLASS[128:] = 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _distinct(unit, h, n):
    both = np.sort(unit.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))
    first = np.append(True, both[1:] != both[:-1])[: len(both)]
    return np.bincount((both[first] >> np.uint64(44)).astype(np.int64), minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, features) of raw UTF-8 bytes; 0 where a ratio has no base."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * 9 + _CLASS[data], minlength=9 * n).reshape(n, 9)
    low = _LOWER[data]
    words = K.Words(low, offsets)
    count = np.diff(words.first)
    lines, first = K.line_offsets(low, offsets)
    per = np.diff(first)
    by_line = K.Words(low, lines)
    h = by_line.sequence_hash()
    line_doc = np.repeat(np.arange(n), per)
    some = h != 0
    used = np.bincount(line_doc[some], minlength=n)
    bytes_ = np.maximum(size, 1)
    words1 = np.maximum(count, 1)
    x = np.zeros((n, len(FEATURES)), np.float32)
    x[:, 0] = np.log1p(count)
    x[:, 1] = np.bincount(words.unit, weights=words.size, minlength=n) / words1
    for k, kind in ((2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 8), (8, 6), (14, 7)):
        x[:, k] = kinds[:, kind] / bytes_
    x[:, 9] = np.log1p(per)
    x[:, 10] = count / np.maximum(used, 1)
    x[:, 11] = _distinct(words.unit, words.hash, n) / words1
    x[:, 12] = 1 - _distinct(line_doc[some], h[some], n) / np.maximum(used, 1)
    x[:, 12][used == 0] = 0
    x[:, 13] = np.bincount(words.unit, weights=words.size <= 3, minlength=n) / words1
    return x


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees in a row; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    threshold: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] > self.cut[at], self.right[at], self.left[at])
        return self.value[at].sum(axis=1) + self.base


def boost(x: np.ndarray, y: np.ndarray, directions, trees=60, depth=4, rate=0.15, bins=64, least=10, l2=1.0) -> Forest:
    """Fit by Newton steps on the log loss."""
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins)[1:-1])).astype(np.float32) if n else np.empty(0, np.float32) for k in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1) if n else np.empty((0, f), int)
    p = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    score = np.full(n, base)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node(v):
        k = len(feature)
        feature.append(0), cut.append(np.float32(np.inf)), left.append(k), right.append(k), value.append(v)
        return k

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        roots.append(node(0.0))
        todo = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            k, rows, low, high, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[k] = float(np.clip(gs / (hs + l2), low, high)) * rate
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                for j in range(f):
                    if not len(edges[j]):
                        continue
                    b, m = binned[rows, j], len(edges[j]) + 1
                    gl, hl, c = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (g[rows], h[rows], None))
                    gr, hr = gs - gl, hs - hl
                    vl, vr = np.clip(gl / (hl + l2), low, high), np.clip(gr / (hr + l2), low, high)
                    gain = gl * vl + gr * vr - (hl + l2) * vl**2 / 2 - (hr + l2) * vr**2 / 2 - gs**2 / (hs + l2) / 2
                    gain[(c < least) | (len(rows) - c < least) | ((vr - vl) * directions[j] < 0)] = -np.inf
                    t = int(np.argmax(gain))
                    if gain[t] > best[0]:
                        best = (gain[t], j, t, vl[t], vr[t])
            if best[1] is None:
                score[rows] += value[k]
                continue
            _, j, t, vl, vr = best
            mid, d = (vl + vr) / 2, directions[j]
            go = binned[rows, j] > t
            feature[k], cut[k] = j, edges[j][t]
            left[k], right[k] = node(0.0), node(0.0)
            todo.append((left[k], rows[~go], max(low, mid) if d < 0 else low, min(high, mid) if d > 0 else high, level + 1))
            todo.append((right[k], rows[go], max(low, mid) if d > 0 else low, min(high, mid) if d < 0 else high, level + 1))
    if not roots:
        roots.append(node(0.0))
    return Forest(np.array(feature), np.array(cut, np.float32), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)


def _examples(it):
    for batch, data, offsets in K.batches(it, lower=False):
        x = statistics(data, offsets)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "y": batch.column(2), "x": pa.array([r.tobytes() for r in x], pa.binary())})


def train(x, y, goods: float = 1.0) -> Forest:
    """Every fifth row only sets the threshold; each good one counts ``goods`` times."""
    held = np.arange(len(y)) % 5 == 0
    forest = boost(x[~held], y[~held].astype(float), list(FEATURES.values()))
    cut = -best_threshold(-forest.score(x[held]), 1 - y[held], goods) if held.any() else 0.0
    return Forest(**{**forest.__dict__, "threshold": cut})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Forest:
    """Trees from at most 2 x ``per_class`` labelled documents."""
    rows = labelled(docs, labels, "quality", per_class).mapInArrow(_examples, "doc_id long, y int, x binary").toArrow().sort_by([("doc_id", "ascending")])
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, len(FEATURES))
    return train(x, rows.column("y").to_numpy(), skew(labels, "quality", per_class, rare=0))


def _scores(forest: Forest):
    def run(it):
        for batch, data, offsets in K.batches(it, lower=False):
            s = forest.score(statistics(data, offsets))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(s >= forest.threshold)], names=[*batch.schema.names, "quality_score", "keep"])

    return run


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """``docs`` with ``quality_score`` (log odds of good) and ``keep``.

    Defined cases: a null text scores as an empty one, whose statistics are all
    0; repeated rows each have the same score; columns named like the results
    are replaced. An empty table gives an empty table.
    """
    own = docs.drop("quality_score", "keep")
    return own.mapInArrow(_scores(forest), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", quality_score double, keep boolean")
