"""Each operator on small tables: brute force, and nulls, empty and repeated rows, clashing columns, empty tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from archivum.llm import decontaminate, fingerprints, jaccard_join, language_model, packing, quality, substring_dedup, token_counts, toxicity, url_filter

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, node long, row long, score double"


def _text(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(r.integers(0, 20, n), r.integers(0, 9, n), strict=True))


def _rows():
    long = _text(1, 300)
    near = long.split()
    near[40] = "changed"
    texts = [None, "", "  \n ", "one two", "one  TWO", long, " ".join(near), long, _text(2, 80), _text(3, 30) + " " + " ".join(long.split()[50:90]), "é 名 " * 40, "x" * 500, "x" * 500 + "y"]
    rows = [(i, t, "en", "s", 0, 7, 7, 7, 0.5) for i, t in enumerate(texts)]
    return rows + [rows[8], (None, _text(2, 80), "en", "s", 0, 7, 7, 7, 0.5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _components(rows):
    sets = {r[0]: _set(r[1]) for r in rows if r[0] is not None}
    label = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return label, {k: len(s) for k, s in sets.items()}


def test_jaccard_join(docs, empty):
    got = [r for r in jaccard_join.jaccard_components(docs).collect()]
    label, size = _components(_rows())
    assert len(got) == len(_rows())
    named = [r for r in got if r.doc_id is not None]
    assert {r.doc_id: r.component_id for r in named} == label
    assert {r.doc_id: r.n_shingles for r in named} == size
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_crowded_keys_lose_no_link(spark):
    base = _text(5, 120).split()
    rows = []
    for i in range(60):
        w = list(base)
        r = np.random.default_rng(i)
        for p in r.choice(120, 1 + i % 3, replace=False):
            w[p] = f"edit{i}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _components(rows)[0]


def test_pigeonhole_keys_meet():
    r = np.random.default_rng(0)
    for n in (1, 4, 5, 6, 20, 63, 300, 1000):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        for drop in {0, n // 10, max(0, n // 5 - 1)}:
            b = a[drop:] if drop else a
            if len(b) and 5 * len(b) >= 4 * len(a):
                assert set(jaccard_join._keys(a).tolist()) & set(jaccard_join._keys(b).tolist()), (n, drop)


def test_packing(docs, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = packing.best_fit_packing(docs).collect()
    total = 0
    for text in {r[1] for r in _rows()}:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for r in rows:
            if r.doc_id is not None and _rows()[r.doc_id][1] == text:
                assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(by) <= math.ceil(total / packing.CAPACITY) + 1
    assert packing.best_fit_packing(empty).count() == 0


def test_packing_plan_covers_every_piece():
    r = np.random.default_rng(4)
    counts = np.zeros(packing.CAPACITY, np.int64)
    np.add.at(counts, np.clip(r.lognormal(6, 1, 3000).astype(int), 1, packing.CAPACITY) - 1, 1)
    plan, _ = packing.solve(counts)
    held = Counter()
    for config, times in plan:
        assert sum(config) <= packing.CAPACITY
        for size in config:
            held[size] += times
    assert all(held[i + 1] == c for i, c in enumerate(counts.tolist()))
    least = math.ceil((counts * np.arange(1, packing.CAPACITY + 1)).sum() / packing.CAPACITY)
    assert least <= sum(t for _, t in plan) <= packing._best_fit(counts, packing.CAPACITY).total()


def test_token_counts(docs, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = token_counts.token_counts(docs).collect()
    assert len(got) == len(_rows())
    for r in got:
        if r.doc_id is not None:
            text = _rows()[r.doc_id][1] or ""
            n = len(t.encode(text, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)
    counter = token_counts._counter("byte_bpe_50k.json")
    for text in ("a<|endoftext|>b", " \n\n x", "it's \x1c!\x1c! 12", "\u3000z  'll"):
        assert counter.count(text) == len(t.encode(text, add_special_tokens=False).ids)
    assert token_counts.token_counts(empty).count() == 0


def test_fingerprints(docs, empty, spark):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect() if r.doc_id is not None}
    assert got[5].fingerprint == got[7].fingerprint != got[8].fingerprint
    assert got[0].fingerprint == got[1].fingerprint == got[2].fingerprint == ""
    assert fingerprints.fingerprints(docs).count() == len(_rows())
    assert fingerprints.fingerprints(empty).count() == 0
    rows = [(10 * i, _text(i, 50 + 7 * i)) for i in range(30)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    back = rows[::-1]
    for i, (doc, text) in enumerate(back):
        after, part = back[(i + 1) % len(back)][1], len(text) // 3
        edited = text[: len(text) - part] + after[:part]
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        true = len(_set(text) & _set(edited)) / len(_set(text) | _set(edited))
        assert abs(got[doc].near_edited - true) < 0.25


def test_decontamination(spark, docs, empty, monkeypatch):
    item = " ".join(_text(1, 300).split()[50:80])
    bench = spark.createDataFrame([(1, item), (1, item), (2, _text(99, 30)), (3, None), (4, "one two"), (5, _text(1, 300).split()[7] + " " + _text(1, 300).split()[8]), (None, "x")], "item_id long, text string")
    short = {(5, 5), (6, 5), (7, 5)}
    want = short | {(5, 1), (6, 1), (7, 1), (9, 1), (3, 4), (4, 4)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want
    import duckdb

    from archivum.llm.registry import DECONTAMINATION_SQL

    con = duckdb.connect()
    con.register("documents", docs.where("doc_id is not null").dropDuplicates(["doc_id"]).toPandas())
    con.register("benchmark", bench.where("item_id is not null").dropDuplicates().toPandas())
    assert {tuple(r[:2]) for r in con.execute(DECONTAMINATION_SQL).fetchall()} == want | short
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", 0)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_substring_dedup(docs, empty):
    rows = _rows()
    least = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                least[b[i : i + 50]] = min(least.get(b[i : i + 50], 1 << 60), d)
    got = substring_dedup.removed_bytes(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            continue
        b = (rows[r.doc_id][1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < r.doc_id:
                gone[i : i + 50] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), int(gone.sum()), spans)
        assert r.kept_sha256 == hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()
    assert substring_dedup.removed_bytes(empty).count() == 0
    cut = substring_dedup.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_language_model(docs, empty):
    rows, count = _rows(), Counter()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    for d, t, *_ in rows:
        if not held(d):
            count.update(tokens(t))
    total, distinct = sum(count.values()), len(count)
    got = language_model.language_model_scores(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            w = tokens(rows[r.doc_id][1])
            base = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(count[x] > 0 for x in w), total)
            assert abs(r.base_score - base) < 1e-6 and r.score < 0
    assert language_model.language_model_scores(empty).count() == 0


def test_language_model_gradients():
    lm = language_model
    model = lm.GatedModel.start(np.random.default_rng(1).random(lm.VOCABULARY) * 50)
    model.w = {k: v.astype(float) + (0.05 * np.random.default_rng(2).normal(size=v.shape) if k in ("wc", "ww") else 0) for k, v in model.w.items()}
    inputs, targets = np.random.default_rng(3).integers(0, 900, (2, 8, 3))
    fresh = np.zeros((8, 3), bool)
    fresh[3, 1] = fresh[0, 2] = True
    live = np.ones((8, 3), bool)
    live[5:, 0] = False
    start = np.random.default_rng(4).normal(0, 0.3, (3, lm.HIDDEN))

    def loss():
        h, out = start, []
        for t in range(8):
            h = model.gates((model.w["wx"] + model.w["b"])[inputs[t]], np.where(fresh[t, :, None], 0, h))[0]
            out.append(model.output(h, targets[t])[0][live[t]])
        return -np.mean(np.concatenate(out))

    grad, _ = model.train(inputs, targets, fresh, live, start)
    word = int(targets[1, 1])
    for name, at in (("u", (1, 1)), ("b", (1,)), ("wc", (1, 1)), ("bc", (1,)), ("wx", (int(inputs[2, 1]), 5)), ("wx", (int(inputs[1, 2]), 60)), ("ww", (word // lm.EACH, 3, word % lm.EACH)), ("bw", (word // lm.EACH, word % lm.EACH))):
        model.w[name][at] += 1e-4
        up = loss()
        model.w[name][at] -= 2e-4
        down = loss()
        model.w[name][at] += 1e-4
        assert abs((up - down) / 2e-4 - grad[name][at]) < 1e-4, name


def test_language_model_score_is_the_sum_of_its_steps():
    lm = language_model
    r = np.random.default_rng(8)
    model = lm.GatedModel.start(r.random(lm.VOCABULARY) * 50)
    model.w = {k: (v + r.normal(0, 0.1, v.shape)).astype(np.float32) for k, v in model.w.items()}
    texts = [np.append(r.integers(0, lm.VOCABULARY - 1, n), lm.VOCABULARY - 1) for n in (0, 1, 5, 40, 700)]
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    want, every = [], np.arange(lm.VOCABULARY)
    for text in texts:
        h, x, total = np.zeros((1, lm.HIDDEN), np.float32), lm.VOCABULARY - 1, 0.0
        for k, symbol in enumerate(text.tolist()):
            h = model.gates((model.w["wx"] + model.w["b"])[[x]], h)[0]
            if k < 3:  # the probabilities of all symbols sum to one
                p = np.exp(model.output(np.repeat(h, lm.VOCABULARY, axis=0), every)[0])
                assert abs(p.sum() - 1) < 1e-4 and abs(np.log(p[symbol]) - model.output(h, np.array([symbol]))[0][0]) < 1e-3
            total += float(model.output(h, np.array([symbol]))[0][0])
            x = symbol
        want.append(total)
    got = model.score(np.concatenate(texts), first)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_attention_and_its_gradients():
    r = np.random.default_rng(4)
    net = quality.Attention.start()
    net.w["mean"], net.w["scale"] = r.normal(0, 0.1, quality.FEATURES), 1 + r.random(quality.FEATURES)
    first, y = np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0])
    x = r.normal(0, 1, (9, quality.FEATURES))
    f = net.forward(x, first)
    for k in range(3):  # each document by itself, passage by passage
        e = [np.tanh((p - net.w["mean"]) / net.w["scale"] @ net.w["we"] + net.w["be"]) for p in x[first[k] : first[k + 1]]]
        s = np.exp([np.dot(np.tanh(v @ net.w["wv"]) / (1 + np.exp(-(v @ net.w["wu"]))), net.w["wa"]) for v in e])
        z = sum(a * v for a, v in zip(s / s.sum(), e, strict=True))
        assert abs(f["p"][k] - 1 / (1 + np.exp(-(z @ net.w["wo"] + net.w["bo"][0])))) < 1e-12

    def loss():
        p = net.forward(x, first)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grad = net.step(x, first, y)
    for name, g in grad.items():
        for at in {tuple(i) for i in r.integers(0, g.shape, (6, g.ndim))}:
            net.w[name][at] += 1e-5
            up = loss()
            net.w[name][at] -= 2e-5
            down = loss()
            net.w[name][at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-7, name


def test_url_filter(spark):
    urls = [None, "", "no host", "http://A.Example.COM/en/75?x#y", "https://example.com/en/1", "http://notexample.com/en/7", "x://de.example.net/de/8", "http://net/de/", "http://org?/es/", "http://example.org/es/#a"]
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(len(urls))] == [(None, "allow")] * 3 + [("example.com/en/7", "allow"), ("com/en/", "block"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "block"), (None, "allow"), ("org/es/", "block")]
    assert (got[3].host, got[3].path) == ("a.example.com", "/en/75")
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


def test_url_rules_have_the_words_of_the_contract(spark):
    rules = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{v} {r}" for r, v in url_filter.RULES] == rules.split(", ")
    pages = spark.createDataFrame([(1, "http://a.net/de/1"), (2, "http://example.net/de/8"), (3, "http://example.net/de/7")], "page_id long, url string")
    assert sorted((r.page_id, r.rule, r.verdict) for r in url_filter.url_verdicts(pages).collect()) == [(1, "net/de/", "allow"), (2, "example.net/de/8", "block"), (3, "net/de/", "allow")]


def _labelled(spark):
    rows, labels = [], []
    for i in range(400):
        text, bad = _text(i, 60), i % 4 == 0
        w = text.split()
        if bad:
            for k in range(5, 60, 12):
                w[k] = ["idiot", "grobba"][k % 2]
        junk = i % 3 == 0
        rows.append((i, " ".join(w).upper().replace(" ", "!! ") if junk else " ".join(w), "en", "s", 0, 7, 7, 7, 0.5))
        labels.append((i, int(not junk), int(bad)))
    return spark.createDataFrame(rows + _rows()[:3], SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (9999, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("scores", "truth"), [(quality.quality_scores, lambda i: int(i % 3 != 0)), (toxicity.toxicity_scores, lambda i: int(i % 4 == 0))])
def test_classifiers(spark, empty, scores, truth):
    docs, labels = _labelled(spark)
    got = scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id >= 3]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth(r.doc_id) for r in held]) > 0.95
    assert scores(empty, labels).count() == 0
    assert scores(docs, labels.limit(0)).count() == docs.count()


def test_reading_speech_and_negation():
    g = toxicity.Grammar({})
    plain, negated, reported = (g.features([t])[0, 0] for t in ("you are an idiot", "you are not an idiot", "he said you are an idiot"))
    assert plain > reported > 0 and plain > negated > 0
    assert g.features(["I will kill you"])[0, 0] > g.features(["kill the lights"])[0, 0] == 0
    far, before, after = (g.features([t])[0, 0] for t in ("not a single one of you is an idiot", "you are an idiot", "an idiot"))
    assert far == negated < after < before


def test_composed_transducer_takes_the_best_path():
    from itertools import product

    one, whole = toxicity.transducers(), toxicity.Grammar({}).whole
    r = np.random.default_rng(9)
    for _ in range(300):
        symbols = r.integers(1, 7, r.integers(1, 6)).tolist()
        weights = np.where(np.isin(symbols, (1, 2)), r.random(len(symbols)).round(2), 0).tolist()
        best, paths = 0.0, [(tuple(t.start for t in one), 0.0)]
        for s, w in zip(symbols, weights, strict=True):
            paths = [(tuple(x[0] for x in step), total + w * math.prod(x[1] for x in step)) for states, total in paths for step in product(*(t.at(q, s) for t, q in zip(one, states, strict=True)))]
        best = max((total for states, total in paths if all(q in t.final for t, q in zip(one, states, strict=True))), default=0.0)
        assert abs(whole.best(symbols, weights) - best) < 1e-9


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    docs, labels = _labelled(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(_text(1, 60).split()[20:50]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert 1 not in ids and 2 in ids and not any(i in ids for i in range(3, 400, 3))
    assert len(ids & set(range(400))) > 250


def test_word_hashes_do_not_depend_on_other_texts():
    from archivum.llm import hashing

    hashing._POWERS = np.ones(1, np.uint64)
    before = hashing.words([b"ab ba abc"])[0]
    after = hashing.words([b"y" * 300, b"ab ba abc"])[0]
    assert before.tolist() == after[1:].tolist() and len(set(before.tolist())) == 3


def test_language_model_learns_each_symbol_once():
    lm = language_model
    r = np.random.default_rng(0)
    for sizes in ([1], [1, 1, 1], [3, 900, 17, 1, 64], [5000], r.integers(1, 60, 200).tolist()):
        symbol, first = r.integers(0, lm.VOCABULARY, sum(sizes)), np.concatenate(([0], np.cumsum(sizes)))
        seen, begun = [], 0
        for inputs, targets, fresh, live, begin in lm.lanes(symbol, first, 8):
            assert not (begin and live.any())
            seen.extend(targets[live].tolist())
            begun += int((fresh & live).sum())
        assert sorted(seen) == sorted(symbol.tolist()) and begun == len(sizes)


def test_language_model_beats_the_base_on_held_out_texts(spark):
    # each word is followed by one of two words, so what came before tells nearly everything
    rows = []
    for i in range(4000):
        r, k, out = np.random.default_rng(i), i % 40, []
        for bit in r.integers(0, 2, 120).tolist():
            out.append(f"w{k}")
            k = (3 * k + 7 * bit + 1) % 40
        rows.append((i, " ".join(out)))
    got = [r for r in language_model.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect() if r.held_out]
    base, score = (sum(getattr(r, c) for r in got) / sum(r.n_tokens for r in got) for c in ("base_score", "score"))
    assert len(got) > 100 and score > base + 0.3


def test_a_long_clause_is_read_from_its_first_word_to_its_last():
    g = toxicity.Grammar({})
    far = " word" * 3000
    assert g.features([f"you will see{far} kill"])[0, 0] > 0 == g.features([f"they see{far} kill"])[0, 0]
    once, twice = (g.features([t])[0] for t in (f"idiot{far}", f"idiot{far * 2} idiot"))
    assert once[2] == twice[2] and twice[0] > once[0]


def test_training_takes_every_passage():
    text = _text(1, 48 * 200)
    batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array([1.0])], ["text", "y"])
    (row,) = next(quality._feature_rows(iter([batch]))).to_pylist()
    assert sum(row["words"]) == 48 * 200
    assert np.frombuffer(row["x"], "<f4").reshape(-1, quality.MAKE_UP).shape[0] == len(quality.passages([text.encode()])[0]) >= 200


def test_densification_takes_the_first_filled_bin_of_the_attempts(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(n)) for i, n in ((0, 1), (1, 5), (2, 8), (3, 20))]
    own = spark.createDataFrame([(t,) for t in texts], "text string")
    hashes = fingerprints.F.transform(fingerprints.F.split("text", " "), lambda x: fingerprints.F.xxhash64(x))
    n = fingerprints.F.size(hashes)
    runs = fingerprints.F.transform(fingerprints.F.sequence(fingerprints.F.lit(1), n - 4), lambda i: fingerprints.F.xxhash64(fingerprints.F.slice(hashes, i, fingerprints.F.lit(5))))
    shingles = fingerprints.F.when(n >= 5, runs).otherwise(fingerprints.F.array(fingerprints.F.xxhash64(hashes)))
    for r in fingerprints.with_bins(own, fingerprints.F.col("text"), "bins").select("bins", shingles.alias("s")).collect():
        kept = {}
        for h in sorted(r.s):
            kept.setdefault((h % 2**64) >> 57, h & 255)
        want = []
        for i in range(fingerprints.BINS):
            at, attempt = i, 0
            while at not in kept:
                at, attempt = fingerprints._donor(attempt, i), attempt + 1
            want.append(kept[at])
        assert list(r.bins) == want


def test_a_row_without_an_id_links_its_neighbours(spark):
    base = [f"w{i}" for i in range(204)]
    at = lambda *k: " ".join(f"c{i}" if i in k else w for i, w in enumerate(base))
    left, middle, right = at(20, 60, 100), at(), at(40, 80, 120)
    sets = [_set(t) for t in (left, middle, right)]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert alike(sets[0], sets[1]) >= 0.8 <= alike(sets[1], sets[2]) and alike(sets[0], sets[2]) < 0.8
    rows = [(1, left, "en", "s", 0, 7, 7, 7, 0.5), (None, middle, "en", "s", 0, 7, 7, 7, 0.5), (3, right, "en", "s", 0, 7, 7, 7, 0.5)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (3, 1)]


def test_pipeline_drops_repeats_by_id_and_text(spark):
    import corpus_pipeline

    texts = [(1, _text(50, 40)), (1, _text(51, 40)), (1, _text(50, 40)), (None, _text(52, 40)), (None, _text(52, 40)), (None, _text(53, 40)), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 7, 7, 7, 0.5) for i, t in texts], SCHEMA)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    assert Counter(map(tuple, got)) == Counter(set(texts))


def _removed(rows):
    """Brute force: per row what bytes a smaller id has."""
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(least.get(b[i : i + 50], 1 << 60), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return Counter(out)


def test_substring_dedup_tells_texts_of_one_id_apart(spark):
    a, b = _text(60, 12), _text(61, 12)
    for rows in ([(5, a), (7, a), (7, b)], [(5, a + b), (7, a + b), (7, b + a), (7, b + a)], [(1, b), (7, a), (7, a + b), (9, b + a)]):
        own = spark.createDataFrame([(d, t, "k", "r") for d, t in rows], "doc_id long, text string, kept string, row string")
        got = Counter(map(tuple, substring_dedup.removed_bytes(own).collect()))
        assert got == _removed(rows)
        cut = substring_dedup.without_repeats(own)
        assert cut.columns == own.columns and cut.count() == len(rows) and {(r.kept, r.row) for r in cut.collect()} == {("k", "r")}


def test_shared_passages_of_many_texts_are_cut_in_slices_too(spark, monkeypatch):
    passage = _text(70, 25)
    rows = [(i, f"{_text(i, 15 + i % 5)} {passage} {_text(i + 500, 10)}") for i in range(40)] + [(99, _text(71, 400) + passage + _text(3, 15))]
    want = _removed(rows)
    own = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substring_dedup.removed_bytes(own).collect())) == want
    big = [(t or "").encode() for _, t in rows]
    whole = [substring_dedup.anchors([b]) for b in big]
    monkeypatch.setattr(substring_dedup, "SLICE", 256)
    for b, (_, at, h) in zip(big, whole, strict=True):
        _, there, same = substring_dedup.anchors([b])
        assert set(zip(at.tolist(), h.tolist())) == set(zip(there.tolist(), same.tolist()))


def test_common_keys_dealt_by_salt_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COMMON", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 300)
    base = _text(5, 60).split()
    rows = []
    for i in range(40):
        w = list(base)
        for p in np.random.default_rng(i).choice(60, 1 + i % 2, replace=False):
            w[p] = f"edit{i}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _components(rows)[0]


def test_long_texts_are_hashed_in_slices():
    from archivum.llm import hashing

    text = (_text(8, 4000) + " " + "x" * 9000 + " end").encode()
    for limit in (100, 5000, 1 << 20):
        assert hashing.word_hashes([text], limit)[0].tolist() == hashing.words([text])[0].tolist()
    assert hashing.word_hashes([b" " * 300], 100)[0].tolist() == []
