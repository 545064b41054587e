"""What the operators keep on disk and hold, beside their results."""

from __future__ import annotations

import time
from pathlib import Path

import numpy as np

from archivum.llm import substring_dedup
from archivum.llm.common import FREE, materialize
from archivum.llm.hashing import U


def test_anchor_blocks_round_trip():
    rng = np.random.default_rng(3)
    own = np.concatenate((np.sort(rng.integers(0, 5_000, 20_000)), [-(2**63), 2**63 - 1, 0, -1]))
    key = rng.integers(0, 2**48, len(own), dtype=U)
    salted = rng.random(len(own)) < 0.1
    bucket = key % U(40)
    packed = substring_dedup.pack(bucket, key, salted, own)
    assert packed.num_rows == 40
    got = []
    for b, block in zip(packed.column("bucket").to_pylist(), packed.column("block").to_pylist(), strict=True):
        k, s, d = substring_dedup.unpack([block])
        assert (k.view(U) % U(40) == b).all()
        got += zip(k.tolist(), s.tolist(), d.tolist(), strict=True)
    assert sorted(got) == sorted(zip(key.tolist(), salted.astype(int).tolist(), own.tolist(), strict=True))
    # both blocks of a list come back
    k, s, d = substring_dedup.unpack(packed.column("block").to_pylist())
    assert sorted(zip(k.tolist(), s.tolist(), d.tolist(), strict=True)) == sorted(got)


def test_anchors_take_few_bytes_a_row():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 123, 3_000, dtype=np.uint8)).decode() for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    n = size = 0
    for out in substring_dedup._anchor_blocks(64)(iter([batch])):
        blocks = out.column("block").to_pylist()
        n += len(substring_dedup.unpack(blocks)[0])
        size += len(pa.compress(b"".join(blocks), "lz4", asbytes=True)) + 40 * len(blocks)
    assert n > 300 * 3_000 / 20
    assert size < 9 * n  # rows of (key, salt, doc_id) took more than 14


def test_freed_shuffles(spark):
    place = Path(spark.sparkContext.getConf().get("spark.local.dir"))

    def held() -> set:
        return {p for p in place.rglob("shuffle_*.data")}

    rows = spark.range(20_000).selectExpr("id % 97 as k", "id").repartition(4, "k")
    before, setting = held(), spark.conf.get(FREE, None)
    kept = materialize(rows, "kept")
    assert held() - before
    before = held()
    freed = materialize(rows.selectExpr("k", "id + 1 as id"), "freed", free=True)
    for _ in range(100):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
    assert kept.count() == freed.count() == 20_000
    assert spark.conf.get(FREE, None) == setting


def test_merged_spans():
    rng = np.random.default_rng(5)
    row, lo = np.sort(rng.integers(0, 40, 300)), rng.integers(0, 2_000, 300)
    hi = lo + 50 + rng.integers(0, 30, 300)
    want = []
    for r in range(40):
        runs: list[list[int]] = []
        for a, b in sorted(zip(lo[row == r].tolist(), hi[row == r].tolist(), strict=True)):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        want += [(r, a, b) for a, b in runs]
    got = substring_dedup.merge(row, lo.astype(np.int32), hi.astype(np.int32))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == want
    assert [len(x) for x in substring_dedup.merge(row[:0], lo[:0], hi[:0])] == [0, 0, 0]


def test_new_words_of_letters_need_no_pattern():
    """Most new words of a corpus are letters alone: they go to the ranks at once, with the library's ids."""
    import public_tokenizers as public

    from archivum.llm.mixture_packing import WordIds

    ids = WordIds(public.path("word_bpe_49k.json"))
    mixed = "don't I'LL we've. 'tis a1b2 İx ſa ªºµ 1²½ 中文 --- zé!? " + "A" * 3000
    letters = "Abc dEf unheard " + "zé" * 900 + " éier ßŉ " + "q" * 70_000
    for text in (mixed, letters, "", " "):
        assert np.frombuffer(ids.of(text.encode()), ids.kind).tolist() == ids.library.encode(text, add_special_tokens=False).ids
    want = ids.of(letters.encode())
    ids.cache.clear()
    ids.PATTERN = None
    assert ids.of(letters.encode()) == want


def test_anchors_of_a_chunk_hold_few_arrays():
    import tracemalloc

    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 2_000, dtype=np.uint8)) for _ in range(500)]
    tracemalloc.start()
    text, at, key = substring_dedup.anchors(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all at once took 72 MB
    one = [substring_dedup.anchors([t]) for t in texts]
    assert text.tolist() == np.repeat(np.arange(500), [len(a) for _, a, _ in one]).tolist()
    assert at.tolist() == np.concatenate([a for _, a, _ in one]).tolist() and key.tolist() == np.concatenate([k for *_, k in one]).tolist()


def test_keys_of_several_rows_are_told_bucket_by_bucket(monkeypatch):
    from collections import Counter

    rng = np.random.default_rng(6)
    key, own, salted = rng.integers(0, 3_000, 5_000, dtype=U), rng.integers(0, 900, 5_000), rng.random(5_000) < 0.2
    times = Counter(key[~salted].tolist())
    want = sorted((d, k) for d, k, s in zip(own.tolist(), key.tolist(), salted.tolist(), strict=True) if s or times[k] > 1)
    packed = substring_dedup.pack(key % U(7), key, salted, own)
    halves = [packed.slice(0, 3), packed.slice(3)]
    for held in (500_000, 60):  # a bucket at once, and some of its keys at a time
        monkeypatch.setattr(substring_dedup, "UNPACKED", held)
        got = [x for out in substring_dedup._several(iter(halves)) for x in zip(out.column("doc_id").to_pylist(), out.column("key").to_pylist(), strict=True)]
        assert sorted(got) == want
    assert list(substring_dedup._several(iter([]))) == []


def _python_functions_in_a_task(plan: str) -> int:
    """The most Python functions, each with a worker of its own, that follow each other without an exchange."""
    most, path = 0, []
    for line in plan.split("== Final Plan ==")[-1].split("+- == Initial Plan ==")[0].splitlines():
        node = line.lstrip(" :+-")
        depth = len(line) - len(node)
        while path and path[-1][0] >= depth:
            path.pop()
        n = path[-1][1] if path else 0
        n = 0 if "Exchange" in node.split("(")[0] else n + node.split(") ")[-1].startswith("MapInArrow")
        path.append((depth, n))
        most = max(most, n)
    return most


def test_tasks_have_one_python_worker(spark, monkeypatch):
    plans = []

    def run(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    def seen(df, name, **how):
        if name in ("spans", "merged"):
            run(df)
        return materialize(df, name, **how)

    monkeypatch.setattr(substring_dedup, "materialize", seen)
    passage = "a passage that stands in each of the texts, longer than fifty bytes " * 2
    docs = spark.createDataFrame([(i, f"{i} begins so, then comes {passage} and ends as {i * i}") for i in range(60)], "doc_id long, text string")
    run(substring_dedup.without_repeats(docs))
    assert len(plans) == 3
    assert max(_python_functions_in_a_task(p) for p in plans) == 1  # were two, and so four workers in an executor of two cores
