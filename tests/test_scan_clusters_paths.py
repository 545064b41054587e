"""Byte ranges of mbox files, clusters and paths, against whole-file reading, duckdb and brute force."""

import itertools
import random

import numpy as np
import pytest

from archivum.operators import clusters, paths
from archivum.sources import mailbox, mbox_scan

FILES = {
    "plain": b"".join(b"From a%d@x.org Thu Jan 01 00:00:00 19%02d\nSubject: s%d\n\nbody %d\n>From quoted 1970\nFrom here on no year\n\n" % (i, 70 + i % 20, i, i) for i in range(12)),
    "crlf": b"".join(b"From b Thu Jan 01 00:00:00 1970\r\nSubject: s%d\r\n\r\nline\r\n\r\n" % i for i in range(6)),
    "noend": b"preamble\n\nFrom c 1970\nSubject: one\n\n\xff\xfe bytes\nFrom d 1971\n\n   \nFrom e 1972\nSubject: last\n\nno line end",
    "blank": b"From c 1970\n\n\nFrom d 1971\n",
    "nothing": b"",
    "text": b"no envelope\nFrom nobody\n",
    "long": b"From f 1999\nSubject: long\n\n" + b"".join(b"%06d abcdefghijklmnop\n" % i for i in range(60)) + b"From g 2000\nSubject: end\n\nx\n",
}


@pytest.mark.parametrize(("size", "piece"), [(23, 50), (301, 100), (1 << 20, 1 << 20)])
def test_ranges_give_the_messages_of_the_whole_file(spark, tmp_path, monkeypatch, size, piece):
    monkeypatch.setattr(mbox_scan, "PIECE", piece)
    files = {k: v for k, v in FILES.items() if size > 60 or k in ("noend", "blank", "nothing")}
    for name, data in files.items():
        (tmp_path / f"{name}.mbox").write_bytes(data)
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = mbox_scan.scan_mbox(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for name, data in files.items():
        own = sorted((r for r in got if r.path.endswith(f"/{name}.mbox")), key=lambda r: r.ordinal)
        assert [bytes(r.content) for r in own] == list(mailbox.split_mbox(data)), name
        for r in own:
            raw = data[r.start : r.start + r.length]
            assert raw.startswith(b"From ") and raw.partition(b"\n")[2].lstrip(b"\r\n") == bytes(r.content) and r.whole


def test_a_message_above_the_ceiling_has_headers_and_a_place(spark, tmp_path):
    (tmp_path / "long.mbox").write_bytes(FILES["long"])
    got = {r.ordinal: r for r in mbox_scan.scan_mbox(spark, str(tmp_path), ceiling=1000).collect()}
    assert (bytes(got[0].content), got[0].whole, got[0].start) == (b"Subject: long", False, 0)
    assert got[1].whole and FILES["long"][got[1].start :][: got[1].length] == b"From g 2000\nSubject: end\n\nx\n"
    fields = mbox_scan.scanned_messages(mbox_scan.scan_mbox(spark, str(tmp_path), ceiling=1000)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.subject, r.error) for r in fields] == [(0, "long", None), (1, "end", None)]
    assert mbox_scan.unquoted(b"a\n>From b\n>>From c\n> From\n") == b"a\nFrom b\n>From c\n> From\n"


def _vectors(spark, n=600, dims=8, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dims))
    rows = [(i, (centres[i % 5] * (1 + r.random()) + 0.25 * r.normal(size=dims)).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, [0.0] * dims), (n + 2, [1.0] * (dims - 1)), (n + 3, rows[0][1]), (n + 4, [float("nan")] * dims)]
    return spark.createDataFrame(rows, "id long, v array<double>"), rows


def test_clusters_are_the_same_however_rows_are_dealt(spark):
    df, rows = _vectors(spark)
    found = []
    for parts in (1, 8):
        q = clusters.unit_vectors(df.repartition(parts), "id", "v", 8).cache()
        centres, history = clusters.spherical_kmeans(q, 5, 8, seed=4)
        assert all(a >= b for a, b in zip(history, history[1:])) and len(history) > 1
        found.append((centres.tolist(), history, sorted(map(tuple, clusters.assign(q, centres).select("id", "cluster").collect()))))
    assert found[0] == found[1]
    label = dict(found[0][2])
    assert set(label) == {i for i, v in rows if v and len(v) == 8 and any(x and x == x for x in v)}
    assert label[603] == label[0]
    assert all(len({label[i] for i in range(c, 600, 5)}) == 1 for c in range(5))  # the planted clusters


def test_each_row_has_its_nearest_centre_by_sql(spark):
    import duckdb

    df, _ = _vectors(spark)
    q = clusters.unit_vectors(df, "id", "v", 8)
    centres, _ = clusters.spherical_kmeans(q, 4, 8, seed=1)
    got = clusters.assign(q, centres).toPandas()
    con = duckdb.connect()
    con.register("got", got)
    con.register("rows", df.where("id < 600").toPandas())
    con.execute("CREATE TABLE c AS SELECT * FROM (VALUES " + ", ".join(f"({i}, {list(map(float, c))}::DOUBLE[])" for i, c in enumerate(centres)) + ") t(k, centre)")
    wrong = con.execute("SELECT count(*) FROM got JOIN (SELECT id, max(list_cosine_similarity(v::DOUBLE[], centre)) AS top FROM rows, c GROUP BY 1) USING (id) WHERE id < 600 AND abs(similarity - top) > 1e-6").fetchone()[0]
    assert wrong == 0


def test_topics_of_texts(spark):
    texts = [(i, " ".join(random.Random(i).choices(("river bank water boat fish" if i % 2 else "market price trade money stock").split(), k=40))) for i in range(80)] + [(80, None), (81, "12 !")]
    df = spark.createDataFrame(texts, "id long, text string")
    found = clusters.topic_clusters(clusters.hashed_text_vectors(df, "id", "text"), 256, seed=2)
    label = {r.id: r.cluster for r in found.collect()}
    assert set(label) == set(range(80))
    words = {r.cluster: set() for r in clusters.cluster_words(df, "id", "text", found).collect()}
    for r in clusters.cluster_words(df, "id", "text", found).collect():
        words[r.cluster].add(r.word)
    for i in range(80):
        assert ("river" in words[label[i]]) == (i % 2 == 1)
    report = clusters.cluster_report(found).collect()
    assert sum(r.rows for r in report) == 80 and all(0 < r.coherence <= 1 for r in report)
    assert clusters.topic_clusters(clusters.hashed_text_vectors(df.limit(0), "id", "text"), 256).count() == 0
    assert [clusters.topic_count(n) for n in (1, 59, 60, 100, 10**9)] == [2, 2, 3, 5, 8]


def _path(edges, a, b):
    near = {}
    for x, y in edges:
        if x != y:
            near.setdefault(x, set()).add(y)
    best, level = None, [(a,)]
    if a not in near or b not in near:
        return None
    if a == b:
        return (a,)
    seen = {a}
    while level and best is None:
        after = [(*p, y) for p in level for y in sorted(near[p[-1]]) if y not in seen]
        seen |= {p[-1] for p in after}
        done = [p for p in after if p[-1] == b]
        best = min(done) if done else None
        level = after
    return best


def test_paths_equal_search_by_hand(spark):
    r = random.Random(7)
    for nodes, many in ((12, 14), (30, 34), (9, 30)):
        one = [(f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}") for _ in range(many)]
        both = sorted({e for x, y in one for e in ((x, y), (y, x))})
        edges = spark.createDataFrame([(x, y, 1) for x, y in both], "a string, b string, weight long").cache()
        for a, b in itertools.islice(itertools.combinations([f"n{i}" for i in range(nodes)], 2), 0, 66, 11):
            got = [x.node for x in paths.shortest_path(edges, a, b).orderBy("step").collect()]
            assert got == list(_path(both, a, b) or ())
    assert paths.shortest_path(edges, "n0", "gone").count() == 0
    assert [tuple(x) for x in paths.shortest_path(edges, both[0][0], both[0][0]).collect()] == [(0, both[0][0])]


def test_graphs_compared(spark):
    old = spark.createDataFrame([("a", "b", 5), ("a", "c", 1), ("b", "c", 9), ("d", "a", 2), ("d", "a", 2)], "a string, b string, weight long")
    new = spark.createDataFrame([("a", "b", 8), ("a", "c", 3), ("b", "c", 1), ("e", "a", 2)], "a string, b string, weight long")
    assert sorted(map(tuple, paths.compare_graphs(old, new).collect())) == [("a", "b", 5, 8, "stronger"), ("b", "c", 9, 1, "weaker"), ("d", "a", 4, None, "lost"), ("e", "a", None, 2, "new")]
    assert sorted(map(tuple, paths.compare_nodes(old, new).collect())) == [("d", 4, "lost"), ("e", 2, "new")]
    assert paths.compare_graphs(old.limit(0), new.limit(0)).count() == 0
