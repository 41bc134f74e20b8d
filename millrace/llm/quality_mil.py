"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by a learned layer over
hashed words and byte classes; gated attention (tanh times sigmoid) gives each
passage a weight, learned from the document's label alone; the document's score
is a logistic layer over the weighted sum of its encodings. All passages of a
text count.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .quality_rules import _CLASS, _LOWER
from .samples import labelled, skew
from .toxicity import best_threshold

PER_CLASS = 1500
PASSAGE = 64
BUCKETS, KINDS = 128, 9
WIDTH, GATE = 24, 12


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of 64 words (the last one of a document may
    be shorter), and each document's first passage. A wordless document has one
    passage of its bytes."""
    words = K.Words(_LOWER[data], offsets)
    count = np.diff(words.first)
    per = np.maximum(1, -(-count // PASSAGE))
    first = np.zeros(len(count) + 1, np.int64)
    np.cumsum(per, out=first[1:])
    n = first[-1]
    within = np.arange(len(words.hash)) - words.first[:-1][words.unit]
    of_word = first[:-1][words.unit] + within // PASSAGE
    bag = np.bincount(of_word * BUCKETS + (words.hash >> np.uint64(57)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    starts = np.repeat(offsets[:-1], per)
    opener = within % PASSAGE == 0
    later = opener & (within > 0)
    starts[of_word[later]] = words.start[later]
    size = np.diff(np.append(starts, offsets[-1]))
    kinds = np.bincount(np.repeat(np.arange(n), size) * KINDS + _CLASS[data], minlength=n * KINDS).reshape(n, KINDS)
    bags = np.log1p(bag.astype(np.float32)) * 0.5
    return np.concatenate([bags, kinds / np.maximum(size, 1)[:, None].astype(np.float32) * 4], axis=1).astype(np.float32), first


@dataclass
class Net:
    w: np.ndarray  # features -> WIDTH
    b: np.ndarray
    v: np.ndarray  # WIDTH -> GATE, tanh
    u: np.ndarray  # WIDTH -> GATE, sigmoid
    a: np.ndarray  # GATE -> attention
    o: np.ndarray  # WIDTH -> score, with the bias last
    threshold: float = 0.0

    def forward(self, x: np.ndarray, first: np.ndarray):
        """Scores of the documents, attention of the passages, and what backward needs."""
        h = np.tanh(x @ self.w + self.b)
        t = np.tanh(h @ self.v)
        s = 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * s) @ self.a
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[of]) if len(of) else e
        alpha = e / np.add.reduceat(e, first[:-1])[of] if len(of) else e
        z = np.add.reduceat(alpha[:, None] * h, first[:-1], axis=0) if len(of) else np.empty((0, WIDTH))
        return z @ self.o[:-1] + self.o[-1], alpha, (h, t, s, z, of)

    def gradients(self, x, first, y, l2=1e-4):
        score, alpha, (h, t, s, z, of) = self.forward(x, first)
        ds = (1 / (1 + np.exp(-score)) - y) / len(y)
        dz = ds[:, None] * self.o[:-1]
        do = np.append(z.T @ ds, ds.sum())
        dalpha = (dz[of] * h).sum(axis=1)
        de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, first[:-1])[of])
        dt, dsg = de[:, None] * self.a * s * (1 - t * t), de[:, None] * self.a * t * s * (1 - s)
        dh = alpha[:, None] * dz[of] + dt @ self.v.T + dsg @ self.u.T
        dp = dh * (1 - h * h)
        return [x.T @ dp + l2 * self.w, dp.sum(axis=0), h.T @ dt, h.T @ dsg, (t * s).T @ de, do]


def train(bags: list[np.ndarray], y: np.ndarray, epochs=12, batch=64, rate=0.004, seed=3, goods=1.0) -> Net:
    """Adam on the log loss of documents; every fifth one only sets the threshold,
    each good one counting ``goods`` times."""
    rng = np.random.default_rng(seed)
    f = BUCKETS + KINDS
    net = Net(rng.normal(0, f**-0.5, (f, WIDTH)), np.zeros(WIDTH), rng.normal(0, WIDTH**-0.5, (WIDTH, GATE)), rng.normal(0, WIDTH**-0.5, (WIDTH, GATE)), np.zeros(GATE), np.zeros(WIDTH + 1))
    fit = np.array([k for k in range(len(y)) if k % 5], int)
    held = np.arange(0, len(y), 5)
    parts = [net.w, net.b, net.v, net.u, net.a, net.o]
    m, v, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0

    def pack(rows):
        first = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(bags[k]) for k in rows], out=first[1:])
        return np.concatenate([bags[k] for k in rows]), first

    for _ in range(epochs):
        order = rng.permutation(fit)
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            step += 1
            for p, g, mm, vv in zip(parts, net.gradients(*pack(rows), y[rows]), m, v):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                p -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    for name in "wbvuao":
        setattr(net, name, getattr(net, name).astype(np.float32))
    if len(held):
        net.threshold = -best_threshold(-np.concatenate([net.forward(*pack(held[lo : lo + 256]))[0] for lo in range(0, len(held), 256)]), 1 - y[held], goods)
    return net


def _examples(it):
    for batch, data, offsets in K.batches(it, lower=False):
        x, first = passages(data, offsets)
        x = x.astype(np.float16)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "y": batch.column(2), "x": pa.array([x[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Net:
    """A net from at most 2 x ``per_class`` labelled documents, all passages of each."""
    rows = labelled(docs, labels, "quality", per_class).mapInArrow(_examples, "doc_id long, y int, x binary").toArrow().sort_by([("doc_id", "ascending")])
    bags = [np.frombuffer(x, np.float16).reshape(-1, BUCKETS + KINDS).astype(np.float32) for x in rows.column("x").to_pylist()]
    return train(bags, rows.column("y").to_numpy(), goods=skew(labels, "quality", per_class, rare=0))


def _scores(net: Net):
    def run(it):
        for batch, data, offsets in K.batches(it, lower=False):
            x, first = passages(data, offsets)
            s, alpha, _ = net.forward(x, first)
            top = np.maximum.reduceat(alpha, first[:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s.astype(np.float64)), pa.array(np.diff(first).astype(np.int32)), pa.array(top.astype(np.float64)), pa.array(s >= net.threshold)], names=[*batch.schema.names, "quality_score", "passages", "top_attention", "keep"])

    return run


def score(docs: DataFrame, net: Net) -> DataFrame:
    """``docs`` with ``quality_score`` (log odds of good), ``passages``,
    ``top_attention`` (the largest weight of a passage) and ``keep``.

    Defined cases: null, empty and wordless texts are one passage (of no bytes,
    or of what bytes there are); repeated rows each have the same score; columns
    named like the results are replaced. An empty table gives an empty table.
    """
    own = docs.drop("quality_score", "passages", "top_attention", "keep")
    return own.mapInArrow(_scores(net), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", quality_score double, passages int, top_attention double, keep boolean")
