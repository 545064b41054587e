"""Language-model scores: exact unigram counts over all training texts, and a gated recurrent model with classes.

Unigram: words are counted in tasks, counts meet in one shuffle.  The most frequent words (a fixed number) are broadcast
with their counts; of rarer words each document sends one row a word to a join with the counts.  Texts are read once
more for their symbols, two bytes a word, which both the training and the scoring of the model take.

Model: a gated recurrent unit reads the text word by word, its state carried from window to window through the whole
document, in training too; the output is factored into classes of words.  Words outside its vocabulary are one symbol,
spelled out by the unigram model, so the probabilities of all texts sum to one.  It is trained in tasks by truncated
backpropagation: each task's training documents run through lanes side by side, and every symbol is learned once.  The
tasks' weights are averaged as a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.llm.common import discard, materialize, training_row
from archivum.llm.hashing import chunks, word_hashes

#: Words whose counts are broadcast.
HEAD = 100_000
CLASSES, EACH = 32, 32
#: Symbols of the model: the most frequent words, the end of a text, and one for all other words.
VOCABULARY = CLASSES * EACH
HIDDEN = 24
#: Steps of a window of truncated backpropagation.
WINDOW = 16
#: Texts that run side by side in training, and symbols that are dealt out to them at a time.
LANES, STREAM = 256, 1 << 18
RATE = 0.02
#: Texts that run side by side in scoring, and rows of output that are computed at a time.
SIDE, ROWS = 512, 8192
#: Blobs of weights that are averaged in one place.
FAN_IN = 64
#: The end of a text; no word has this hash but by chance.
END = np.int64(-8152635409923754219)

Weights = dict[str, np.ndarray]


def tokens(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, each text followed by END, and each text's first place (with the end)."""
    h, at = word_hashes(part)
    n = np.diff(at)
    first = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.full(first[-1], END)
    out[np.delete(np.arange(first[-1]), first[1:] - 1)] = h.view(np.int64)
    return out, first


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): once or a few times a task for each word."""
    keys, counts, held = [], [], 0

    def together() -> tuple[np.ndarray, np.ndarray]:
        k, c = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        return k[cut], np.add.reduceat(c, cut)

    for batch in batches:
        for _, _, part in chunks(batch.column("text")):
            k, c = np.unique(tokens(part)[0], return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > 4_000_000:
                k, c = together()
                keys, counts, held = [k], [c], len(k)
                if held > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["word", "n"])
                    keys, counts, held = [], [], 0
    if held:
        k, c = together()
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["word", "n"])


class GatedModel:
    """Weights: wx (input symbol to gates), u (state to gates), b; wc, bc (classes); ww, bw (words of each class)."""

    def __init__(self, weights: Weights):
        self.w = weights

    @classmethod
    def start(cls, counts: np.ndarray) -> GatedModel:
        """Small random weights, and output biases that equal the counts' unigram model."""
        r = np.random.default_rng(3)
        f = np.float32
        p = (counts + 0.5).reshape(CLASSES, EACH)
        return cls({
            "wx": (r.normal(0, 0.1, (VOCABULARY, 3 * HIDDEN))).astype(f), "u": (r.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))).astype(f), "b": np.concatenate((np.full(HIDDEN, 2.0), np.zeros(2 * HIDDEN))).astype(f),
            "wc": np.zeros((HIDDEN, CLASSES), f), "bc": np.log(p.sum(1) / p.sum()).astype(f), "ww": np.zeros((CLASSES, HIDDEN, EACH), f), "bw": np.log(p / p.sum(1, keepdims=True)).astype(f),
        })

    def gates(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state from an input's part ``x`` and the state ``h``; also z, r, c and the state's part of c."""
        n = HIDDEN
        g = h @ self.w["u"]
        zr = x[:, : 2 * n] + g[:, : 2 * n]
        zr *= 0.5
        np.tanh(zr, out=zr)  # the logistic function
        zr *= 0.5
        zr += 0.5
        z, r, gc = zr[:, :n], zr[:, n:], g[:, 2 * n :]
        c = r * gc
        c += x[:, 2 * n :]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        return new, z, r, c, gc

    def output(self, h: np.ndarray, target: np.ndarray, grad: Weights | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of targets; with ``grad``, gradients are added and those of ``h`` returned."""
        w = self.w
        order = np.argsort((target // EACH).astype(np.uint8), kind="stable")
        h, target = h[order], target[order]
        c, word = np.divmod(target, EACH)
        cut = np.searchsorted(c, np.arange(CLASSES + 1))
        runs = [(k, slice(cut[k], cut[k + 1])) for k in range(CLASSES) if cut[k] < cut[k + 1]]
        rows = np.arange(len(target))

        def log_softmax(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
            s -= s.max(1, keepdims=True)
            own = s[rows, at]
            np.exp(s, out=s)
            total = s @ np.ones(s.shape[1], s.dtype)
            if grad is None:
                return own - np.log(total), None
            s /= total[:, None]
            s[rows, at] -= 1
            return own - np.log(total), s

        s = h @ w["wc"]
        s += w["bc"]
        by_class, d = log_softmax(s, c)
        dh = None
        if grad is not None:
            grad["wc"] += h.T @ d
            grad["bc"] += d.sum(0)
            dh = d @ w["wc"].T
        s = np.empty((len(target), EACH), by_class.dtype)
        for k, own in runs:
            np.matmul(h[own], w["ww"][k], out=s[own])
            s[own] += w["bw"][k]
        by_word, d = log_softmax(s, word)
        out = np.empty_like(by_class)
        out[order] = by_class + by_word
        if grad is None:
            return out, None
        for k, own in runs:
            grad["ww"][k] += h[own].T @ d[own]
            grad["bw"][k] += d[own].sum(0)
            dh[own] += d[own] @ w["ww"][k].T
        back = np.empty_like(dh)
        back[order] = dh
        return out, back

    def train(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[Weights, np.ndarray]:
        """Gradients of the mean loss over a window, and the lanes' last states.

        Rows are steps, columns lanes.  Where ``fresh``, a text begins and the state is zero; where not ``live``, there
        is nothing to learn.  ``h``: the lanes' states before the window.
        """
        w, n = self.w, HIDDEN
        steps, lanes = inputs.shape
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        x = (w["wx"] + w["b"])[inputs]
        before, states, z, r, c, gn = (np.empty((steps, lanes, n), x.dtype) for _ in range(6))
        starts = fresh.any(axis=1)
        for t in range(steps):
            if starts[t]:
                h = np.where(fresh[t, :, None], x.dtype.type(0), h)
            before[t] = h
            h, z[t], r[t], c[t], gn[t] = self.gates(x[t], h)
            states[t] = h
        flat = states.reshape(-1, n)
        if live.all():
            count = targets.size
            d_states = self.output(flat, targets.reshape(-1), grad)[1]
        else:
            some = np.flatnonzero(live.reshape(-1))
            d_states, count = np.zeros_like(flat), max(1, len(some))
            if len(some):
                d_states[some] = self.output(flat[some], targets.reshape(-1)[some], grad)[1]
        d_states = d_states.reshape(steps, lanes, n)
        to_c, to_z, to_r = (1 - z) * (1 - c * c), (before - c) * z * (1 - z), gn * r * (1 - r)
        dx, dg = (np.empty((steps, lanes, 3 * n), x.dtype) for _ in range(2))
        dh, u = np.zeros((lanes, n), x.dtype), np.ascontiguousarray(w["u"].T)
        for t in range(steps - 1, -1, -1):
            dh += d_states[t]
            dc = np.multiply(dh, to_c[t], out=dx[t, :, 2 * n :])
            np.multiply(dh, to_z[t], out=dg[t, :, :n])
            np.multiply(dc, to_r[t], out=dg[t, :, n : 2 * n])
            np.multiply(dc, r[t], out=dg[t, :, 2 * n :])
            dh *= z[t]
            dh += dg[t] @ u
            if starts[t]:
                dh[fresh[t]] = 0
        dx[:, :, : 2 * n] = dg[:, :, : 2 * n]
        dx = dx.reshape(-1, 3 * n)
        grad["u"] += before.reshape(-1, n).T @ dg.reshape(-1, 3 * n)
        grad["b"] += dx.sum(0)
        symbol = inputs.reshape(-1).astype(np.uint16)
        order = np.argsort(symbol, kind="stable")
        sorted_ = symbol[order]
        cut = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        grad["wx"][sorted_[cut]] += np.add.reduceat(dx[order], cut)
        for v in grad.values():
            v /= count
        return grad, h

    def score(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log-probability of each text, the state carried through it; texts of like lengths run side by side."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        out = np.zeros(len(size))
        table = self.w["wx"] + self.w["b"]
        for lo in range(0, len(order), SIDE):
            own = order[lo : lo + SIDE]
            begin, length = first[:-1][own], size[own]
            h = np.zeros((len(own), HIDDEN), np.float32)
            states, targets, owner, held = [], [], [], 0

            def add() -> None:
                h_all, target = np.concatenate(states), np.concatenate(targets)
                p = np.concatenate([self.output(h_all[i : i + ROWS], target[i : i + ROWS])[0] for i in range(0, len(target), ROWS)])
                out[own] += np.bincount(np.concatenate(owner), p, len(own))  # noqa: B023

            ends = np.searchsorted(-length, -np.arange(int(length[0])), "left")  # texts of more than t symbols
            for t, live in enumerate(ends.tolist()):
                at = begin[:live] + t
                h, *_ = self.gates(table[symbols[at - 1]] if t else np.broadcast_to(table[VOCABULARY - 1], (live, table.shape[1])), h[:live])
                states.append(h)
                targets.append(symbols[at])
                owner.append(np.arange(live))
                held += live
                if held >= 4 * ROWS:
                    add()
                    states, targets, owner, held = [], [], [], 0
            if held:
                add()
        return out


class Vocabulary:
    """The head words' counts by hash, and the model's symbols: the most frequent, END last, the others' before it."""

    def __init__(self, words_: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.norm = np.log10(total + 0.5 * (distinct + 1))
        top = [i for i in np.lexsort((words_, -counts)).tolist() if words_[i] != END][: VOCABULARY - 2]
        symbol = np.full(len(words_), VOCABULARY - 2)
        symbol[top] = np.arange(len(top))
        symbol[words_ == END] = VOCABULARY - 1
        order = np.argsort(words_)
        self.words, self.counts, self.symbol = words_[order], counts[order], symbol[order].astype(np.int32)
        self.logs = np.log10(self.counts + 0.5) - self.norm
        in_model = np.zeros(VOCABULARY)
        np.add.at(in_model, self.symbol, self.counts)
        known = sum(int(c) for c, s in zip(self.counts, self.symbol, strict=True) if s != VOCABULARY - 2)
        kinds = int((self.symbol != VOCABULARY - 2).sum())
        in_model[VOCABULARY - 2] = total - known
        self.symbol_counts = in_model
        #: log10 of the unigram model's probability of a word outside the vocabulary
        self.other = np.log10((total - known) + 0.5 * (distinct + 1 - kinds)) - self.norm

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is a head word, log10 of its unigram probability or 0, symbol) of words."""
        if not len(self.words):
            return np.zeros(len(h), bool), np.zeros(len(h)), np.where(h == END, VOCABULARY - 1, VOCABULARY - 2)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        found = self.words[at] == h
        return found, np.where(found, self.logs[at], 0.0), np.where(found, self.symbol[at], np.where(h == END, VOCABULARY - 1, VOCABULARY - 2))


def _pack(w: Weights) -> bytes:
    return b"".join(w[k].astype("<f4").tobytes() for k in sorted(w))


def _unpack(data: bytes, like: Weights) -> Weights:
    flat, at, out = np.frombuffer(data, "<f4"), 0, {}
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def lanes(symbol: np.ndarray, first: np.ndarray, width: int = LANES) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows (inputs, targets, fresh, live, begin) of some texts end to end, cut into lanes of equal length.

    Each symbol is a live target once.  A lane that begins inside a text starts with a window that only carries the
    state, from the symbols before it; ``begin`` is true for the first window of the lanes.
    """
    total = len(symbol)
    width = max(1, min(width, total // WINDOW))
    length = -(-total // width)
    is_first = np.zeros(total, bool)
    is_first[first[:-1]] = True
    base = np.arange(width) * length
    for lo in range(-WINDOW, length, WINDOW):
        step = np.arange(lo, lo + WINDOW)
        at = base[None, :] + step[:, None]
        inside = (at >= 0) & (at < total) & (step < length)[:, None]
        at = np.where(inside, at, 0)
        inputs = np.where(inside & (at > 0), symbol[at - 1], VOCABULARY - 1)
        yield inputs, np.where(inside, symbol[at], VOCABULARY - 1), is_first[at] & inside, inside & (step >= 0)[:, None], lo < 0


def _learner(weights):
    """A task that trains on all symbols of its texts and gives its weights with the number of its updates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, w, at = np.frombuffer(_pack(weights.value), "<f4").copy(), {}, 0
        for k in sorted(weights.value):  # views of one array
            w[k] = flat[at : at + weights.value[k].size].reshape(weights.value[k].shape)
            at += weights.value[k].size
        model, t = GatedModel(w), 0
        m, v = np.zeros_like(flat), np.zeros_like(flat)

        def update(grad: Weights) -> None:
            nonlocal t, m, v, flat
            t += 1
            g = np.concatenate([grad[k].reshape(-1) for k in sorted(grad)])
            np.clip(g, -1, 1, out=g)
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            v *= np.float32(0.99)
            g *= g
            g *= np.float32(0.01)
            v += g
            np.multiply(v, np.float32(1 / (1 - 0.99**t)), out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-6)
            np.divide(m, g, out=g)
            g *= np.float32(RATE / (1 - 0.9**t))
            flat -= g

        def learn(texts: list[np.ndarray]) -> None:
            first = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
            h = None
            for inputs, targets, fresh, live, begin in lanes(np.concatenate(texts).astype(np.int64), first):
                if begin:  # nothing to learn yet
                    h, table = np.zeros((inputs.shape[1], HIDDEN), np.float32), w["wx"] + w["b"]
                    for k in range(len(inputs)):
                        h = model.gates(table[inputs[k]], np.where(fresh[k, :, None], np.float32(0), h))[0]
                    continue
                grad, h = model.train(inputs, targets, fresh, live, h)
                update(grad)

        held, size = [], 0
        for batch in batches:
            for x in batch.column("symbols"):
                held.append(np.frombuffer(x.as_py(), "<i2"))
                size += len(held[-1])
                if size >= STREAM:
                    learn(held)
                    held, size = [], 0
        if size:
            learn(held)
        if t:
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([flat.astype("<f4").tobytes()], pa.binary())], ["n", "weights"])

    return run


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        for k, data in zip(batch.column("n").to_pylist(), batch.column("weights").to_pylist(), strict=True):
            x = np.frombuffer(data, "<f4") * float(k)
            total, n = (x if total is None else total + x), n + k
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], ["n", "weights"])


def train(symbols: DataFrame, vocabulary: Vocabulary) -> GatedModel:
    """A model from all training texts' ``symbols``: each task learns on its own, weights are averaged as a tree.

    No more than FAN_IN sets of weights (about 400 KB each) reach the driver.
    """
    spark = symbols.sparkSession
    model = GatedModel.start(vocabulary.symbol_counts)
    sent = spark.sparkContext.broadcast(model.w)
    found = materialize(symbols.mapInArrow(_learner(sent), "n long, weights binary"), "weights")
    while (blobs := found.count()) > FAN_IN:
        found = materialize(found.repartition(-(-blobs // FAN_IN)).mapInArrow(_mean, "n long, weights binary"), "weights")
    rows = found.collect()
    n = sum(x["n"] for x in rows)
    if n:
        flat = sum((np.frombuffer(x["weights"], "<f4") * (x["n"] / n) for x in sorted(rows, key=lambda x: (x["n"], x["weights"]))), np.zeros(1, "<f4"))
        model = GatedModel(_unpack(flat.astype("<f4").tobytes(), model.w))
    return model


_READ = "row long, doc_id long, n_tokens long, known long, base double, other double, words array<long>, times array<long>, symbols binary"


def _reader(vocabulary):
    """Rows of texts: sums over head words, the rarer words that are still to be looked up, and the model's symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, number = vocabulary.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, part in chunks(batch.column("text")):
                h, first = tokens(part)
                n = np.diff(first)
                found, log, symbol = voc.look(h)
                doc = np.repeat(np.arange(len(part)), n)
                outside = symbol == VOCABULARY - 2
                known, base, other = np.bincount(doc, found, len(part)).astype(np.int64), np.bincount(doc, log, len(part)), np.bincount(doc, np.where(outside, log - voc.other, 0.0), len(part))
                rare = np.flatnonzero(~found)
                order = rare[np.lexsort((h[rare], doc[rare]))]
                k, d = h[order], doc[order]
                cut = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))) if len(k) else np.zeros(0, np.int64)
                places = pa.array(np.concatenate(([0], np.cumsum(np.bincount(d[cut], minlength=len(part))))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(places, pa.array(x.astype(np.int64))) for x in (k[cut], np.diff(np.append(cut, len(k))))]
                raw = symbol.astype("<i2").tobytes()
                bodies = pa.array([raw[2 * a : 2 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
                ids = batch.column("doc_id").slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(part))), ids, pa.array(n), pa.array(known), pa.array(base), pa.array(other), *lists, bodies], ["row", "doc_id", "n_tokens", "known", "base", "other", "words", "times", "symbols"])
                number += len(part)

    return run


def _scorer(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = GatedModel(weights.value)
        for batch in batches:
            texts = [np.frombuffer(x.as_py(), "<i2") for x in batch.column("symbols")]
            if texts:
                first = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
                score = model.score(np.concatenate(texts).astype(np.int64), first) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_tokens", "known", "base")), pa.array(score + batch.column("other").to_numpy())], ["row", "doc_id", "n_tokens", "known", "base", "model"])

    return run


def language_model_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null or empty text is its end alone.  Rows that repeat count each, in training too; a null doc_id is a training
    row.  Without training texts all counts are 0 and the model is uniform over its symbols.  A very long text is hashed
    slice by slice; its symbols are held by one task.  Further columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = own.where(training_row(held_out=1)).select("text")
    counts = materialize(texts.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = counts.orderBy(F.desc("n"), "word").limit(HEAD).collect()
    vocabulary = Vocabulary(np.array([r["word"] for r in head], np.int64), np.array([r["n"] for r in head], np.int64), total, distinct)
    read = materialize(own.mapInArrow(_reader(spark.sparkContext.broadcast(vocabulary)), _READ), "read")
    model = train(read.where(training_row(held_out=1)).select("symbols"), vocabulary)
    weights = spark.sparkContext.broadcast(model.w)
    scored = read.select("row", "doc_id", "n_tokens", "known", "base", "other", "symbols").mapInArrow(_scorer(weights), "row long, doc_id long, n_tokens long, known long, base double, model double")
    scored = materialize(scored, "scored")
    rare = read.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    norm = float(vocabulary.norm)
    log = F.log10(F.coalesce("n", F.lit(0)) + 0.5) - norm
    tail = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(log * F.col("times")).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    tail = materialize(tail, "tail")
    discard(read, counts)
    done = scored.join(tail, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return done.select(
        "doc_id",
        (~training_row(held_out=1)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
