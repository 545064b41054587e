"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is described by its words, hashed to buckets, and by the make-up of its
bytes, encoded by a small network, and weighted by gated attention; the weighted encoding gives the score.  Weights are learned by Adam in numpy
from a bounded sample of labelled documents; all passages of every document are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.llm.common import training_row
from archivum.llm.hashing import U, chunks, words
from archivum.llm.labelled import training_sample

#: Words in a passage.
PASSAGE = 48
#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 6000
HIDDEN = 16
GATE = 8
EPOCHS = 20
#: Buckets that a passage's words are hashed to.
BUCKETS = 128
THRESHOLD = 0.3

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b"#$%&*+<=>@\\^_~{}[]/", b".", b",", b"\n", b"?;:\"'()-"]
_KIND = np.zeros(256, np.uint8)
for _i, _c in enumerate(_CLASSES):
    for _x in _c:
        _KIND[_x] = _i + 1
MAKE_UP = len(_CLASSES) + 6
FEATURES = MAKE_UP + BUCKETS


def passages(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and each text's first passage (with the end).  No words: one passage of zeros."""
    h, at, _, starts, ends = words(part)
    kind = _KIND[np.frombuffer(b" ".join(part) + b" ", np.uint8)]
    raw = np.frombuffer(b" ".join(part) + b" ", np.uint8)
    kind = np.where((raw >= 0x80) & (raw <= 0x9E) & (np.concatenate(([0], raw[:-1])) == 0xC3), 1, kind)  # Latin-1 capitals in UTF-8
    n = np.diff(at)
    count = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros((first[-1], FEATURES), np.float32)
    if not len(h):
        return out, first
    doc = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(h)) - at[doc]
    own = first[doc] + inside // PASSAGE
    begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    rows = own[begin]
    size = np.diff(np.append(begin, len(h)))
    span = np.minimum(starts[begin], len(kind) - 1)
    length = (ends - starts).astype(float)
    chars = np.add.reduceat(length, begin)
    for i in range(len(_CLASSES)):
        out[rows, i] = np.add.reduceat((kind == i + 1).astype(np.int32), span) / (chars if i == 0 else size)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    k = len(_CLASSES)
    out[rows, k] = np.minimum(chars / size, 40) / 10
    out[rows, k + 1] = np.add.reduceat(same, begin) / size
    key = np.sort((own.astype(U) << U(40)) | (h >> U(24)))
    distinct = np.concatenate(([True], key[1:] != key[:-1]))
    out[rows, k + 2] = np.bincount((key[distinct] >> U(40)).astype(np.int64), minlength=first[-1])[rows] / size
    out[rows, k + 3] = np.log1p(size) / 4
    out[rows, k + 4] = np.add.reduceat((raw >= 0x80).astype(np.int32), span) / chars
    out[rows, k + 5] = np.log1p(n[doc[begin]]) / 8
    out[:, MAKE_UP:] = np.bincount(own * BUCKETS + (h % U(BUCKETS)).astype(np.int64), minlength=int(first[-1]) * BUCKETS).reshape(-1, BUCKETS)
    return out, first


class Attention:
    """Encoder, gated attention and output weights."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = w

    @classmethod
    def start(cls, seed: int = 5) -> Attention:
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        return cls({"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES), "we": g(FEATURES, HIDDEN), "be": np.zeros(HIDDEN), "wv": g(HIDDEN, GATE), "wu": g(HIDDEN, GATE), "wa": g(GATE, 1)[:, 0], "wo": g(HIDDEN, 1)[:, 0], "bo": np.zeros(1)})

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, begin = self.w, first[:-1]
        x = np.clip((x - w["mean"]) / w["scale"], -6, 6)
        e = np.tanh(x @ w["we"] + w["be"])
        v, u = np.tanh(e @ w["wv"]), 1 / (1 + np.exp(-(e @ w["wu"])))
        s = (v * u) @ w["wa"]
        bag = np.repeat(np.arange(len(begin)), np.diff(first))
        a = np.exp(s - np.maximum.reduceat(s, begin)[bag])
        a /= np.add.reduceat(a, begin)[bag]
        z = np.add.reduceat(a[:, None] * e, begin)
        p = 1 / (1 + np.exp(-np.clip(z @ w["wo"] + w["bo"][0], -30, 30)))
        return {"x": x, "e": e, "v": v, "u": u, "a": a, "z": z, "p": p, "bag": bag}

    def step(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy."""
        w, f = self.w, self.forward(x, first)
        d = (f["p"] - y) / len(y)
        dz = d[:, None] * w["wo"]
        da = (f["e"] * dz[f["bag"]]).sum(1)
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, first[:-1])[f["bag"]])
        dg = ds[:, None] * w["wa"]
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        de = f["a"][:, None] * dz[f["bag"]] + dv @ w["wv"].T + du @ w["wu"].T
        dx = de * (1 - f["e"] ** 2)
        return {"we": f["x"].T @ dx, "be": dx.sum(0), "wv": f["e"].T @ dv, "wu": f["e"].T @ du, "wa": (f["v"] * f["u"]).T @ ds, "wo": f["z"].T @ d, "bo": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> Attention:
        w = self.w
        w["mean"] = x.mean(0, dtype=float)
        w["scale"] = np.array([x[:, k].std(dtype=float) for k in range(x.shape[1])]) + 1e-3
        w["scale"][MAKE_UP:] *= 8  # many weak features: small steps
        r, t = np.random.default_rng(11), 0
        m, v = ({k: np.zeros_like(w[k]) for k in w if k not in ("mean", "scale")} for _ in range(2))
        for epoch in range(epochs):
            order = r.permutation(len(y))
            lr = rate * (0.1 + 0.9 * (1 - epoch / epochs))
            for lo in range(0, len(y), batch):
                bags = order[lo : lo + batch]
                rows = np.concatenate([np.arange(first[b], first[b + 1]) for b in bags])
                cut = np.concatenate(([0], np.cumsum(first[bags + 1] - first[bags])))
                t += 1
                for k, g in self.step(x[rows], cut, y[bags]).items():
                    g = g + decay * w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y, rows = batch.column("y").to_pylist(), []
        for lo, _, part in chunks(batch.column("text")):
            x, first = passages(part)
            for k in range(len(part)):
                own = x[first[k] : first[k + 1]]
                rows.append((y[lo + k], np.ascontiguousarray(own[:, :MAKE_UP], "<f4").tobytes(), own[:, MAKE_UP:].astype(np.uint8).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["y", "x", "words"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Attention | float:
    """A classifier from at most ``sample`` labelled training documents; the share of label 1 where only one label occurs."""
    rows = training_sample(docs, labels, label, sample).mapInArrow(_feature_rows, "y double, x binary, words binary").collect()
    rows = sorted((r["y"], bytes(r["x"]), bytes(r["words"])) for r in rows)
    if len({y >= 0.5 for y, *_ in rows}) < 2:
        return sum(y for y, *_ in rows) / len(rows) if rows else 0.5
    x = [np.concatenate((np.frombuffer(b, "<f4").reshape(-1, MAKE_UP), np.frombuffer(w, np.uint8).reshape(-1, BUCKETS)), axis=1, dtype=np.float32) for _, b, w in rows]
    first = np.concatenate(([0], np.cumsum([len(b) for b in x])))
    y = np.array([y for y, *_ in rows])
    del rows
    whole = np.empty((int(first[-1]), FEATURES), np.float32)
    for k in range(len(x)):
        whole[first[k] : first[k + 1]], x[k] = x[k], None  # no second copy of all
    return Attention.start().fit(whole, first, y)


def score(docs: DataFrame, model: Attention | float, column: str = "score") -> DataFrame:
    """``docs`` with ``column`` added (0 to 1; in place of one of that name); every passage of every text counts."""
    weights = docs.sparkSession.sparkContext.broadcast(model.w if isinstance(model, Attention) else model)
    schema = docs.drop(column).schema.add(column, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Attention(weights.value) if isinstance(weights.value, dict) else None
        for batch in batches:
            out = []
            for _, _, part in chunks(batch.column("text")):
                out.append(net.forward(*passages(part))["p"] if net else np.full(len(part), weights.value))
            p = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, column])

    return docs.drop(column).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null, empty and blank texts are one empty passage and get its score.  Repeated rows get the same score; a null
    doc_id is no held-out row.  Without labels of both kinds, the score is the share of label 1 (0.5 without labels).
    Further columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(own, fit(docs, labels))
    return out.select("doc_id", (~training_row()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
