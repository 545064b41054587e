import math
import re

import pyarrow as pa

from archivum.operators import review as rv


def test_word_shares_do_not_depend_on_batches():
    rows = [(1, "aa bb aa"), (1, "bb cc x aa"), (2, ""), (3, "\U00010400 dd"), (5, "ee")]
    want = [(1, "aa", 1.0), (1, "bb", 2 / 3), (1, "cc", 1 / 3), (3, "dd", 1.0), (5, "ee", 1.0)]
    schema = pa.schema([("id", pa.int64()), ("words", pa.string())])
    for size in (1, 2, 5):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size], strict=True)], schema=schema) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in rv._word_shares(iter(batches)) for r in b.to_pylist()]
        assert got == want
    assert list(rv._word_shares(iter([]))) == []


def test_predictive_coding_counts_repeated_ids_together_and_shuffles_texts_only(spark):
    rows = [(1, "Good good news"), (1, "more GOOD-bad"), (2, "bad news x"), (3, None), (4, "good"), (None, "good bad"), (5, "other words")]
    df = spark.createDataFrame(rows, "k long, text string")
    codes = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (5, None)], "k long, code int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k long, v array<double>")
    counts: dict = {}
    for k, t in rows:
        for w in re.split(r"[\W_]+", (t or "").lower()):
            if k is not None and len(w) >= 2:
                counts.setdefault(k, {}).setdefault(w, 0)
                counts[k][w] += 1
    idf = {w: math.log(len(rows) / (sum(w in c for c in counts.values()) + 1)) + 1 for c in counts.values() for w in c}
    weight = {k: {w: n / max(c.values()) * idf[w] for w, n in c.items()} for k, c in counts.items()}
    yes, no = weight[1], weight[2]
    seen = set(yes) | set(no)
    every = [sum(x.values()) + len(seen) for x in (yes, no)]
    want = {}
    for k in (1, 2, 3, 4, 5):
        odds = sum(x * (math.log((yes.get(w, 0) + 1) / every[0]) - math.log((no.get(w, 0) + 1) / every[1])) for w, x in weight.get(k, {}).items())
        want[k] = 1 / (1 + math.exp(-(odds + math.log(1) - math.log(2))))
    found = rv.predictive_coding(df, codes, "k", "text", "code", vectors, "v")
    got = {r["k"]: r["bayes"] for r in found.collect() if r["k"] is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
