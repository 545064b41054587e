import random

from pyspark.sql import functions as F

from archivum.operators import resolve as rs


def _groups(texts: dict[int, str | None], least: float = 0.8) -> dict[int, int]:
    """Brute force: every pair of texts by exact similarity, joined by chains."""
    import re

    sets = {}
    for k, t in texts.items():
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        if w:
            sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                ra, rb = root[a], root[b]
                root = {k: min(ra, rb) if r in (ra, rb) else r for k, r in root.items()}
    return {k: r for k, r in root.items() if list(root.values()).count(r) > 1}


def test_near_duplicates_equal_brute_force(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    texts: dict[int, str | None] = {}
    for base in range(12):
        text = [random.choice(words) for _ in range(120)]
        for copy in range(6):
            changed = list(text)
            for _ in range(copy):
                changed[random.randrange(0, 120)] = random.choice(words)
            texts[len(texts)] = " ".join(changed)
    texts |= {200: None, 201: "", 202: "  ,. ", 203: "Only Three words", 204: "only three, WORDS!", 205: "alone", 206: "A long text " + "again " * 30000}
    rows = [*texts.items(), (None, "only three words"), (203, "Only Three words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x"))
    found = rs.near_duplicates(df, "doc_id", "text").collect()
    assert {r["doc_id"]: r["representative"] for r in found} == _groups(texts)
    assert all(0.8 <= r["similarity"] <= 1.0 for r in found)
    assert {r["similarity"] for r in found if r["doc_id"] in (203, 204)} == {1.0}


def test_blocks_of_a_band_change_nothing(spark, monkeypatch):
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    base = [random.choice(words) for _ in range(100)]
    texts = {}
    for k in range(40):  # a drifting text: its ends are unlike, chains of links hold them together
        base[random.randrange(100)] = random.choice(words)
        base[random.randrange(100)] = random.choice(words)
        texts[k] = " ".join(base)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    whole = sorted(map(tuple, rs.near_duplicates(df, "doc_id", "text").collect()))
    assert {r[0]: r[1] for r in whole} == _groups(texts) and all(r[2] < 0.9 for r in whole)
    monkeypatch.setattr(rs, "BLOCK", 200)
    assert sorted(map(tuple, rs.near_duplicates(df, "doc_id", "text").collect())) == whole


def test_links_of_a_group_are_all_found_and_few():
    import numpy as np

    sets = [np.arange(k, k + 40) for k in range(0, 30, 2)]  # neighbours share 38 of 42
    rows = [(k % 2, k, k > 0, s) for k, s in enumerate(sets)]
    found = [x for i, j in ((0, 0), (0, 1), (1, 1)) for x in rs._group_links(rows, i, j, 0.8)]
    every = {(a, b): len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a in range(15) for b in range(a + 1, 15)}
    assert all(every[a, b] == s >= 0.8 for a, b, s in found) and len(found) <= 3 * 2 * 15
    assert min(s for *_, s in found) == min(s for s in every.values() if s >= 0.8)
    label = {k: k for k in range(15)}
    for a, b, _ in found:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {k: new if v == old else v for k, v in label.items()}
    assert set(label.values()) == {0}


def test_shingles_and_bands_are_those_of_spark_functions(spark, monkeypatch):
    import numpy as np

    random.seed(7)
    texts = ["one", "a b c d", "a b c d e", "\u00e9\u00e8 \u4e2d\u6587 x \U00010400 y z", *(" ".join(f"w{random.randrange(30)}" for _ in range(random.randrange(1, 200))) for _ in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, words string").withColumn("w", F.split("words", " "))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1)))
    df = df.select("row", F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("w", i, 5), " "))))).alias("set"))
    seeded = lambda k: F.transform("set", lambda x: F.xxhash64(F.lit(k), x))
    least = [F.array_min(seeded(k)) for k in range(rs.BANDS * rs.IN_BAND)]
    want = df.select("set", F.array(*[F.xxhash64(*least[i : i + rs.IN_BAND]) for i in range(0, len(least), rs.IN_BAND)])).orderBy("row").collect()
    sets = [rs.shingles(t.encode()) for t in texts]
    assert [x.tolist() for x in sets] == [r[0] for r in want] and len(rs.shingles(b"")) == 0
    for at_once in (1, 7, 1 << 14):
        monkeypatch.setattr(rs, "AT_ONCE", at_once)
        assert rs.bands(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])).tolist() == [r[1] for r in want]


def test_near_duplicates_of_nothing(spark):
    assert rs.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_simple_names(spark):
    names = spark.createDataFrame([("Acme, Inc.",), ("ACME  Corp.",), ("O'Neil & Co.",), (None,)], "n string")
    assert [r[0] for r in names.select(rs.simple_name(F.col("n"))).collect()] == ["acme", "acme", "oneil", ""]
