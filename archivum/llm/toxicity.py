"""Toxicity by a weighted finite-state grammar over clauses.

Words are mapped to symbols by a weighted lexicon (insults, threats, targets, negations, reporting verbs, auxiliaries);
insults and their weights are learned from labelled training documents, by how much more often a word stands in
different surroundings in toxic than in clean texts, added to short lists for four languages.  Five transducers (insult and
threat, target, negation, reported speech, intention) are composed into one, and a clause that holds an insult or a
threat has the weight of its best path.  A target raises from where it is read on, or up to it; a threat needs one; reported speech lowers all that follows in its
clause, negation what follows up to the next comma or conjunction.  A document's score is a logistic function of its
matched clauses' weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.llm.common import materialize, training_row
from archivum.llm.hashing import U, chunks, mix, words
from archivum.llm.labelled import training_sample

#: Labelled documents that the lexicon and the logistic function are fitted on, at most.
SAMPLE = 16_000
#: What a learned insult needs: different surroundings in toxic texts, and log-odds.
SUPPORT = 8
LOG_ODDS = 3.5

INSULT, THREAT, TARGET, NOT, REPORT, WILL, AND = 1, 2, 3, 4, 5, 6, 7
#: Seed words by symbol, in four languages.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid scum trash loser losers worthless pathetic disgusting clown imbecile fool dumb idiote imbécile crétin connard salaud abruti stupide débile dummkopf idiotin trottel blödmann arschloch abschaum dumm imbécil estúpido estúpida tonto basura asqueroso pendejo",
    THREAT: "kill hurt destroy beat shoot stab burn tuer frapper détruire brûler töten umbringen schlagen vernichten matar golpear destruir quemar",
    TARGET: "you your yours yourself u tu toi vous votre ton te du dich dir ihr euch dein deine tú usted ustedes vosotros",
    NOT: "not no never isn't aren't don't doesn't wasn't won't can't nor neither without ne pas jamais aucun sans nicht kein keine nie niemals ohne nunca jamás sin tampoco",
    REPORT: "said says say wrote writes quoted reported claimed called according dit écrit déclaré selon sagte schrieb laut berichtete dijo escribió según informó",
    AND: "and but because why when while although though however et mais car pourquoi quand und aber weil warum wenn denn sondern y pero porque cuando aunque",
    WILL: "will gonna going shall should must going'll i'll we'll vais va allons werde wird werden voy vamos va",
}
SEED_WEIGHT = 2.0
#: Bytes of a word's beginning that are learned too, so that forms of an insult that the sample lacks are known.
STEM = 4
FEATURES = 5

_SPLIT = np.ones(256, bool)
_SPLIT[[*range(48, 58), *range(65, 91), *range(97, 123), 39]] = False
_SPLIT[128:] = False
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?;:\n\r|()\""]] = True
_COMMA = np.zeros(256, bool)
_COMMA[ord(",")] = True


def lower(text: str | None) -> str:
    return (text or "").lower().replace("’", "'")


def stems(h: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the first STEM bytes of words longer than that (other words: 0), apart from all words' hashes."""
    out = np.zeros(len(h), U)
    for k in range(STEM):
        out = mix(out + buf[np.minimum(starts + k, len(buf) - 1)] + U(257 * (k + 1)))
    return np.where(ends - starts > STEM, out, U(0))


def word_hash(word: str) -> int:
    return int(words([word.encode("utf-8", "surrogatepass")], _SPLIT)[0].view(np.int64)[0])


class Transducer:
    """A weighted finite-state transducer over word symbols: ``arcs[state][symbol]`` lists (next state, factor).

    A symbol that a state has no arcs for leaves it, with factor 1.  A path's weight is the sum over its words of the
    word's weight times the arc's factor.
    """

    def __init__(self, arcs: dict, start, final: set):
        self.arcs, self.start, self.final = arcs, start, final

    def at(self, state, symbol: int) -> list[tuple]:
        return self.arcs.get(state, {}).get(symbol, [(state, 1.0)])

    def compose(self, other: Transducer) -> Transducer:
        """Both at once: states are pairs, factors are multiplied, a pair is final if both states are."""
        start, arcs = (self.start, other.start), {}
        todo = [start]
        while todo:
            pair = todo.pop()
            if pair not in arcs:
                arcs[pair] = {s: [((p, q), f * g) for p, f in self.at(pair[0], s) for q, g in other.at(pair[1], s)] for s in range(1, AND + 1)}
                todo.extend(to for out in arcs[pair].values() for to, _ in out)
        return Transducer(arcs, start, {p for p in arcs if p[0] in self.final and p[1] in other.final})

    def best(self, symbols: list[int], weights: list[float]) -> float:
        """The weight of the best path that ends in a final state, 0 if there is none."""
        held = {self.start: 0.0}
        for s, w in zip(symbols, weights, strict=True):
            after: dict = {}
            for state, total in held.items():
                for to, f in self.at(state, s):
                    v = total + w * f
                    if v > after.get(to, -1.0):
                        after[to] = v
            held = after
        return max((v for state, v in held.items() if state in self.final), default=0.0)


def transducers() -> list[Transducer]:
    """What each looks at: whether a threat counts at all, target, negation, reported speech, intention."""
    hit = Transducer({0: {INSULT: [(0, 1.0)], THREAT: [(0, 1.0)]}}, 0, {0})
    # "promised": a target is said to follow, which must come true before the clause ends
    target = Transducer({
        "none": {TARGET: [("seen", 1.0)], INSULT: [("none", 1.0), ("promised", 1.25)], THREAT: [("none", 0.0), ("promised", 1.0)]},
        "seen": {TARGET: [("seen", 1.0)], INSULT: [("seen", 1.25)], THREAT: [("seen", 1.0)]},
        "promised": {TARGET: [("seen", 1.0)], INSULT: [("promised", 1.25)], THREAT: [("promised", 1.0)]},
    }, "none", {"none", "seen"})
    # what a word lowers, and what ends that: a conjunction or a comma ends a negation, the clause a report
    negation, report = (Transducer({"off": {s: [("on", 1.0)]}, "on": {INSULT: [("on", f)], THREAT: [("on", f)], **({end: [("off", 1.0)]} if end else {})}}, "off", {"off", "on"}) for s, f, end in ((NOT, 0.25, AND), (REPORT, 0.6, None)))
    intention = Transducer({"off": {WILL: [("on", 1.0)], THREAT: [("off", 0.5)]}}, "off", {"off", "on"})
    return [hit, target, negation, report, intention]


class Grammar:
    """Sorted word hashes with their symbol and weight, and the composed transducer."""

    def __init__(self, insults: dict[int, float]):
        entries = {word_hash(w): (s, SEED_WEIGHT if s in (INSULT, THREAT) else 0.0) for s, names in SEEDS.items() for w in names.split()}
        entries |= {h: (INSULT, w) for h, w in insults.items()}
        keys = sorted(entries, key=lambda h: h % 2**64)
        self.keys = np.array(keys, np.int64).view(U)
        self.symbol = np.array([entries[k][0] for k in keys], np.int8)
        self.weight = np.array([entries[k][1] for k in keys])
        first, *others = transducers()
        for t in others:
            first = first.compose(t)
        self.whole = first

    def clause(self, symbols: np.ndarray, weights: np.ndarray, parted: np.ndarray) -> float:
        """The weight of a clause's best reading; words without a symbol change nothing, ``parted`` ones follow a comma."""
        read: list[tuple[int, float]] = []
        for k in np.flatnonzero((symbols > 0) | parted).tolist():
            if parted[k]:
                read.append((AND, 0.0))
            if symbols[k]:
                read.append((int(symbols[k]), float(weights[k])))
        return self.whole.best([s for s, _ in read], [w for _, w in read])

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: matched clauses' total (log), best clause, clauses (log), weight a word, and whether any matched."""
        out = np.zeros((len(texts), FEATURES))
        for lo, _, part in chunks([lower(t) for t in texts]):
            h, at, buf, starts, ends = words(part, _SPLIT)
            if not len(h):
                continue
            place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            found = self.keys[place] == h
            symbol = np.where(found, self.symbol[place], 0)
            weight = np.where(found, self.weight[place], 0.0)
            stem = stems(h, buf, starts, ends)
            place = np.minimum(np.searchsorted(self.keys, stem), len(self.keys) - 1)
            form = ~found & (self.keys[place] == stem)
            symbol, weight = np.where(form, self.symbol[place], symbol), np.where(form, self.weight[place], weight)
            hot = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
            if not len(hot):
                continue
            stop = np.concatenate(([0], np.cumsum(_END[buf])))
            clause = stop[starts]
            doc = np.searchsorted(at, np.arange(len(h)), "right") - 1
            cut = np.append(np.flatnonzero(np.concatenate(([True], (clause[1:] != clause[:-1]) | (doc[1:] != doc[:-1])))), len(h))
            comma = np.concatenate(([0], np.cumsum(_COMMA[buf])))[starts]
            parted = np.concatenate(([False], comma[1:] != comma[:-1]))
            scores: dict[int, list[float]] = {}
            for k in np.unique(np.searchsorted(cut, hot, "right") - 1).tolist():
                i, edge = int(cut[k]), int(cut[k + 1])
                s = self.clause(symbol[i:edge], weight[i:edge], parted[i:edge])
                if s > 0:
                    scores.setdefault(int(doc[i]), []).append(s)
            for k, v in scores.items():
                n = max(1, int(at[k + 1] - at[k]))
                out[lo + k] = np.log1p(sum(v)), min(max(v), 20.0), np.log1p(len(v)), min(4.0, 10 * sum(v) / n), 1.0
        return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, surroundings and label, once for each task."""
    for batch in batches:
        y = batch.column("y").to_pylist()
        for lo, _, part in chunks([lower(t) for t in batch.column("text").to_pylist()]):
            h, at, buf, starts, ends = words(part, _SPLIT)
            if not len(h):
                continue
            doc = np.searchsorted(at, np.arange(len(h)), "right") - 1
            toxic = np.array([y[lo + k] >= 0.5 for k in range(len(part))])[doc]
            around = np.concatenate(([U(0)], h[:-1])) * U(31) + np.concatenate((h[1:], [U(0)]))
            stem = stems(h, buf, starts, ends)
            for key, keep in ((h, slice(None)), (stem, np.flatnonzero(stem))):
                yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(around[keep].view(np.int64)), pa.array(toxic[keep])], ["word", "around", "toxic"])


def learn_insults(sample: DataFrame) -> dict[int, float]:
    """Word hashes and log-odds of words that stand in more different surroundings in toxic texts than in clean ones.

    Copies of a text repeat a word's surroundings, so they add nothing.  The sample bounds the words that are learned.
    """
    seen = sample.mapInArrow(_contexts, "word long, around long, toxic boolean").distinct()
    both = materialize(seen.groupBy("word").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good")), "word-counts")
    total = both.agg(F.sum("bad"), F.sum("good")).first()
    if not total[0] or not total[1]:
        return {}
    odds = F.log((F.col("bad") + 0.5) / (total[0] + 1.0)) - F.log((F.col("good") + 0.5) / (total[1] + 1.0))
    kept = both.where(F.col("bad") >= SUPPORT).withColumn("odds", odds).where(F.col("odds") >= LOG_ODDS)
    return {r["word"]: min(6.0, r["odds"]) for r in kept.select("word", "odds").collect()}  # of the words of the sample


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for logistic regression; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every row of ``docs``.

    The lexicon is learned from half of the sample, the logistic function from the other half.  Null, empty and blank
    texts match no clause and get the score of such texts.  Repeated rows get the same score; a null doc_id is no
    held-out row.  Without labels of both kinds, scores come from the seed words alone.  A very long clause is read from its
    first word to its last.  Further columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sample = training_sample(docs, labels, label, SAMPLE).withColumn("half", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)))
    grammar = Grammar(learn_insults(sample.where("half = 0")))
    sent = spark.sparkContext.broadcast(grammar)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = sent.value.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "x"])

    rows = sample.where("half = 1").mapInArrow(measured, "y double, x array<double>").collect()
    y = np.array([r["y"] >= 0.5 for r in rows], float)
    if len(set(y)) == 2:
        weights = _logistic(np.array([r["x"] for r in rows]), y)
    else:
        weights = np.array([0.5, 0.2, 0.2, 0.1, 1.0, -2.5])
    model = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = sent.value.features(batch.column("text").to_pylist())
            p = 1 / (1 + np.exp(-np.clip(x @ model.value[:-1] + model.value[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (~training_row()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
