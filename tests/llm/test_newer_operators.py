"""Mixture packing, periodic runs and ranked search on small tables, against brute force and the tokenizers library."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from archivum.llm import fingerprints, mixture_packing, packing, periodic_runs, registry, threshold_search, toxicity

SCHEMA = "doc_id long, text string, source string, queue string, n long, part int, item_id string, rank int, runs string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def _text(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(r.integers(0, 10, n), r.integers(0, 6, n), strict=True))


def _rows():
    texts = [None, "", " \t\n ", "one", _text(1, 3000), _text(1, 3000), "Ça va? It's NOT, don't... x_1 " * 30, "<|startoftext|> a b", "ΣΑΣ ﬁ ½ 　 ÿ", "na na na na na na na batman", "x " * 500]
    texts += [_text(i, 5 + 17 * (i % 9)) for i in range(2, 60)]
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", "q", 1, 1, "i", 1, "r") for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, _text(9, 40), "s1", "q", 1, 1, "i", 1, "r"), (None, None, None, "q", 1, 1, "i", 1, "r")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(None,) * 9] * 3, SCHEMA)


@pytest.fixture(scope="module")
def library():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path("word_bpe_49k.json"))


def _whole(rows, docs, library):
    """Each token of each document is in exactly one piece, sequences have no gap; returns their lengths and pieces."""
    want = Counter(tuple([*library.encode(t or "", add_special_tokens=False).ids, 1]) for _, t, *_ in docs)
    sequences, by_doc, found = defaultdict(list), defaultdict(list), Counter()
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length, r.doc_id))
        by_doc[r.doc_id].append((r.start, r.doc_tokens, ids))
    for doc, pieces in by_doc.items():
        if sum(d[0] == doc for d in docs) > 1:  # rows of one id can't be told apart here
            found.update(tuple(x) for x in ())
            continue
        pieces.sort()
        assert [p[0] for p in pieces] == np.cumsum([0, *(len(p[2]) for p in pieces)])[:-1].tolist()
        own = tuple(i for p in pieces for i in p[2])
        assert all(p[1] == len(own) for p in pieces)
        found[own] += 1
    assert not found - want
    assert sum(r.length for r in rows) == sum(len(k) * v for k, v in want.items())
    lengths = {}
    for k, places in sequences.items():
        at = 0
        for offset, length, _ in sorted(places):
            assert offset == at
            at += length
        lengths[k] = at
    return lengths, sequences


def test_mixture_packing_is_whole_and_without_padding(docs, empty, nulls, library):
    rows = mixture_packing.mixture_packing(docs).collect()
    lengths, _ = _whole(rows, _rows(), library)
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths.values())
    assert sum(n < 2048 for n in lengths.values()) <= 11
    assert mixture_packing.mixture_packing(empty).count() == 0
    assert [r.length for r in mixture_packing.mixture_packing(nulls).collect()] in ([1, 2], [2, 1], [1, 1, 1])
    digests = mixture_packing.mixture_packing(docs, content=mixture_packing.CRC).collect()
    assert sorted(r.ids_crc32 for r in digests) == sorted(zlib.crc32(r.ids) for r in rows)


@pytest.mark.parametrize("queues", [256, 2])
def test_windows_hold_each_source_in_proportion(spark, library, monkeypatch, queues):
    monkeypatch.setattr(mixture_packing, "FAN", 4)  # several levels of blocks
    rows = [(i, _text(i, 30 + i % 50), f"s{min(i % 7, 3)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixture_packing.mixture_packing(docs, capacity=128, queues=queues).collect()
    lengths, sequences = _whole(found, rows, library)
    full = [k for k, n in lengths.items() if n == 128]
    if queues == 2:
        return
    source = {d: s for d, _, s in rows}
    tokens = Counter()
    for r in found:
        tokens[source[r.doc_id]] += r.length
    for k in full:
        held = Counter()
        for _, n, d in sequences[k]:
            held[source[d]] += n
        for s, n in tokens.items():
            assert abs(held[s] - 128 * n / sum(tokens.values())) < 3
    # with targets, a source that runs dry leaves its share to the others, and all is packed still
    found = mixture_packing.mixture_packing(docs, capacity=128, targets={"s0": 3.0, "s1": 1.0}).collect()
    _, sequences = _whole(found, rows, library)
    first = Counter()
    for _, n, d in sequences[0] + sequences[1] + sequences[2]:
        first[source[d]] += n
    assert first["s0"] > 1.3 * first["s1"] and set(first) == {"s0", "s1", "s2", "s3"}


def test_deficits_are_carried_and_everything_is_sent():
    r = np.random.default_rng(0)
    for _ in range(50):
        amounts = r.integers(0, 400, r.integers(1, 7))
        rounds = int(amounts.sum()) // 16
        if not rounds:
            continue
        sent = mixture_packing.deal(amounts, np.full(rounds, 16), amounts / amounts.sum())
        assert (np.diff(sent, axis=1) >= 0).all() and (np.diff(sent.sum(0)) == 16).all() and (sent[:, -1] <= amounts).all()
        assert np.abs(sent - np.arange(rounds + 1) * 16 * amounts[:, None] / amounts.sum()).max() < 2


def test_word_ids_are_the_librarys(library):
    from public_tokenizers import path

    ids = mixture_packing.WordIds(path("word_bpe_49k.json"))
    texts = [t or "" for _, t, *_ in _rows()] + ["A,B wo'rd's 's S I'LL 12a3 a_b-c ``x``", "́x ́ a\x1cb x\x1fy \x85 \x00a", "é É ſ İx ª º µ ŉ ß", "a" * 900, "<|endoftext|>x <|endoftext|>"]
    r = np.random.default_rng(1)
    texts += ["".join(chr(c) for c in r.integers(32, 400, 300)) for _ in range(30)]
    for text in texts:
        assert np.frombuffer(ids.of(text.encode()), ids.kind).tolist() == library.encode(text, add_special_tokens=False).ids


def _runs(w, least=6, exponent=4):
    n, out = len(w), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            smaller = any(all(w[t] == w[t + d] for t in range(s, e - d)) for d in range(1, q))
            if e - s >= max(least, exponent * q) and not smaller:
                out.add((s, e - s, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_equal_brute_force():
    r = np.random.default_rng(3)
    for _ in range(150):
        texts = []
        for _ in range(r.integers(1, 6)):
            n, k = int(r.choice([0, 1, 2, 7, 20, 60])), int(r.choice([1, 2, 3, 8]))
            w = r.integers(0, k, n).tolist()
            if n and r.random() < 0.5:
                a = int(r.integers(0, n))
                p = 1 + (n - a) // int(r.integers(3, 10))
                w = w[:a] + (w[a : a + p] * n)[: n - a]
            texts.append(w)
        sizes = np.array([len(w) for w in texts], np.int64)
        ends = np.cumsum(sizes)
        got = [[] for _ in texts]
        for s, length, q in periodic_runs.runs_of(np.array([x for w in texts for x in w], np.int64), sizes).tolist():
            k = int(np.searchsorted(ends, s, "right"))
            got[k].append((s - int(ends[k] - sizes[k]), length, q))
        assert got == [_runs(w) for w in texts]


def test_periodic_runs_query(docs, empty, nulls, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BATCH", 100)
    got = periodic_runs.run_digests(periodic_runs.periodic_runs(docs, rewrite=periodic_runs.planted)).collect()
    want = []
    for d, t, *_ in _rows():
        w = (t or "").encode().split()
        h, n = zlib.crc32(str(d).encode()), len(w)
        if d is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = _runs(w) if n < 3000 else []
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(r.n_runs > 0 for r in got) >= 3
    assert periodic_runs.periodic_runs(empty).count() == 0
    assert [(r.doc_id, r.runs, r.collapsed) for r in periodic_runs.periodic_runs(nulls).collect()] == [(None, [], "")] * 3


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _ranked(docs, items, top):
    texts = [(d, Counter(_terms(t))) for d, t, *_ in docs]
    some = [c for _, c in texts if c]
    count, length = len(some), sum(sum(c.values()) for c in some)
    out = Counter()
    for item, text in items:
        scored = []
        for d, c in texts:
            score, n = 0, sum(c.values())
            for t in set(_terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * sum(t in x for x in some) + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (100 - 50 + 50 * n * count // length)))
            if score > 0:
                scored.append((-score, d is None, d))
        out.update((item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top]))
    return out


@pytest.mark.parametrize("cells", [16_000_000, 60])
def test_ranked_search_equals_scoring_everything(docs, empty, nulls, spark, monkeypatch, cells):
    monkeypatch.setattr(threshold_search, "CELLS", cells)
    monkeypatch.setattr(threshold_search, "ROUNDS", 1)
    monkeypatch.setattr(threshold_search, "BLOCK_TERMS", 20)  # several blocks of items
    items = [(1, _text(3, 20)), (2, "Alpha0, beta1; GAMMA2 ça"), (3, None), (4, " .,"), (5, _text(3, 20)), (None, "one na"), (7, "alpha0 alpha0 nothing")]
    bench = spark.createDataFrame([(*x, "d", 0) for x in items], "item_id long, text string, doc_id string, score int")
    for top in (50, 3):
        got = Counter(tuple(r) for r in threshold_search.threshold_search(docs, bench, top).select("item_id", "rank", "doc_id", "score").collect())
        assert got == _ranked(_rows(), items, top)
    assert threshold_search.threshold_search(empty, bench).count() == 0
    assert threshold_search.threshold_search(nulls, bench).count() == 0
    assert threshold_search.threshold_search(docs, bench.limit(0)).count() == 0


def test_the_search_stops_before_the_lists_end(monkeypatch):
    r = np.random.default_rng(5)
    n, width = 4000, 6
    impact = np.sort(r.pareto(1.5, (n, width)) * 1000 + 1, 0)[::-1].astype(np.int64)
    for k in range(width):
        impact[:, k] = impact[r.permutation(n), k]
    row, term = np.repeat(np.arange(n), width), np.tile(np.arange(width), n)
    shard = threshold_search.Shard(np.arange(n), np.arange(n + 1) * width, term, impact.ravel(), width)
    looked, table = [], shard.table

    class Counted:
        def __getitem__(self, at):
            looked.append(table[at].size)
            return table[at]

    shard.table = Counted()
    nothing = np.zeros(0, np.int64)
    scores, ids = shard.search(np.arange(3), np.array([3, 2, 1]), (nothing, nothing), 10)
    true = impact[:, :3] @ np.array([3, 2, 1])
    assert ids.tolist() == np.lexsort((np.arange(n), -true))[:10].tolist() and scores.tolist() == sorted(true.tolist(), reverse=True)[:10]
    assert sum(looked) < 0.5 * 3 * n
    assert len(row) == n * width


def test_new_queries_are_registered():
    assert {"op11_mixture_packing", "op12_periodic_runs", "op13_ranked_search"} <= set(registry.queries())
    assert "op13_ranked_search" in registry.oracle_sql()


def _bins(texts, spark):
    own = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r.text: list(r.bins) for r in fingerprints.with_bins(own, fingerprints.F.col("text"), "bins").collect()}


@pytest.mark.parametrize("ids", ["all", "some", "none", "wide"])
def test_the_next_document_and_its_likeness(spark, ids):
    number = {"all": lambda i: i % 37 * 5, "some": lambda i: i if i % 3 else None, "none": lambda i: None, "wide": lambda i: (1 << 60) + i}[ids]
    rows = [(number(i), _text(i % 23, 20 + i % 9)) for i in range(40)]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    bins = _bins({t for _, t in rows}, spark)
    of = {"".join(f"{x:02x}" for x in b): t for t, b in bins.items()}
    assert all(r.n_chars == len(of[r.fingerprint]) for r in got)
    # the rows form one circle: what follows each is told by its edited text
    def edited(text, after):
        part = len(text) // 3
        return hashlib.sha256((text[: len(text) - part] + after[:part]).encode()).hexdigest()

    def near(a, b):
        same = sum(x == y for x, y in zip(bins[a], bins[b], strict=True)) / 128
        return max(0.0, (same - 1 / 256) / (1 - 1 / 256))

    if ids in ("all", "wide"):
        order = sorted(rows, key=lambda r: (-r[0], r[1]))
        want = Counter((d, edited(t, order[(k + 1) % 40][1]), round(near(t, order[(k + 1) % 40][1]), 9)) for k, (d, t) in enumerate(order))
        assert Counter((r.doc_id, r.edited_sha256, round(r.near_next, 9)) for r in got) == want
    else:
        texts = sorted({t for _, t in rows})
        follows = Counter()
        for r in got:
            own = of[r.fingerprint]
            match = [t for t in texts if edited(own, t) == r.edited_sha256 and abs(near(own, t) - r.near_next) < 1e-9]
            assert len(match) == 1
            follows[match[0]] += 1
        assert follows == Counter(t for _, t in rows)  # each row follows exactly one
    assert all((r.near_edited == 1.0) == (r.fingerprint == r.edited_fingerprint) for r in got)
    assert re.fullmatch("[0-9a-f]{256}", got[0].fingerprint)


def _histograms():
    r = np.random.default_rng(4)
    for name, lengths in (("uniform", r.integers(1, 2048, 600)), ("few", r.choice([300, 700, 1025, 1100], 900)), ("one", np.full(300, 700)), ("half", np.full(200, 1025)), ("log-normal", np.clip(r.lognormal(6, 1, 700).astype(int), 1, 2048))):
        counts = np.zeros(2048, np.int64)
        np.add.at(counts, lengths - 1, 1)
        yield name, counts


@pytest.mark.parametrize(("name", "counts"), list(_histograms()))
def test_the_program_is_never_worse_than_best_fit(name, counts):
    plan, _ = packing.solve(counts, rounds=20)
    held = Counter()
    for config, times in plan:
        assert sum(config) <= 2048
        for size in config:
            held[size] += times
    assert all(held[i + 1] == c for i, c in enumerate(counts.tolist()))
    assert sum(t for _, t in plan) <= packing._best_fit(counts, 2048).total()


def test_the_fractional_answer_covers_what_it_can_and_its_bound_holds():
    for name, counts in _histograms():
        counts[2047] = 0
        answer, bound = packing.fractional(counts, 2048, 60, 0)
        load = Counter()
        for config, weight in answer.items():
            for size in config:
                load[size] += weight
        lacking = sum(max(0.0, n - load[i + 1]) * (i + 1) for i, n in enumerate(counts.tolist()))
        assert lacking < 0.2 * (counts * np.arange(1, 2049)).sum(), name
        assert bound <= packing._best_fit(counts, 2048).total() + 1e-6
        assert abs(sum(answer.values()) - bound) < 0.15 * bound


def test_negation_ends_at_a_conjunction_and_a_target_outlasts_a_comma():
    g = toxicity.Grammar({})
    plain, negated = (g.features([t])[0, 1] for t in ("you are an idiot", "you are not an idiot"))
    for text in ("I do not know why you are such an idiot", "it is not late and you are an idiot", "this is not late, you are an idiot", "you, sir, are an idiot"):
        assert g.features([text])[0, 1] == plain
    for text in ("I do not think that you are an idiot", "you are really not such an idiot"):
        assert g.features([text])[0, 1] == negated < plain
    assert g.features(["he said it is late, and you are an idiot"])[0, 1] < plain
