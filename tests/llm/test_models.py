import math
import os
import sys
import zlib
from collections import Counter

import numpy as np

import brute
from tapeloom.llm import langid, lm, mixing, suite
from test_packing_and_files import documents

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle_compare import compare, duck  # noqa: E402


def test_op4_predicts_held_out_languages(spark, folder):
    rows = suite.QUERIES["op4_language_identification"](spark, folder).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r.doc_id: r.held_out for r in rows} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in lang}
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.languages[0] == r.lang_pred for r in rows)


def test_mixed_documents_get_their_languages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    langs, model = langid.learn(docs, "lang", "doc_id", "text")
    halves = {k: next(r.text for r in docs.where(f"lang = '{k}' AND n_chars > 1500").collect())[:1500] for k in ("de", "es")}
    raw = np.frombuffer((halves["de"] + " " + halves["es"]).encode(), np.uint8)
    shares = dict(zip(langs, langid.mixtures(raw, np.array([0, len(raw)]), model)[0]))
    assert set(k for k, s in shares.items() if s > 0) == {"de", "es"} and min(shares["de"], shares["es"]) > 0.35


def test_expectation_maximisation_equals_a_plain_loop():
    rng = np.random.default_rng(0)
    fit, cuts = rng.random((9, 3)), np.array([0, 4])
    got, _ = langid.proportions(fit, cuts, None, np.full((2, 3), 1 / 3), 5)
    for d, part in enumerate((fit[:4], fit[4:])):
        w = np.full(3, 1 / 3)
        for _ in range(5):
            r = part * w
            w = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.allclose(got[d], w)


def test_odd_documents_have_a_language_or_none(spark, odd, nothing):
    rows = langid.identify(odd, carry=("source",)).collect()
    assert len(rows) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (3, 4, 5, 11))
    assert all(r.lang_pred != "und" for r in rows if r.doc_id in (1, 2, 7))
    unlabelled = langid.identify(odd.withColumn("lang", odd["lang"].substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    assert langid.identify(nothing).count() == 0


def base_scores(rows, n=7, held=2):
    tokens = [[*brute.words(x, True), None] for _, x in rows]
    held_out = [zlib.crc32(("" if d is None else str(d)).encode()) % n == held for d, _ in rows]
    counts = Counter(w for t, h in zip(tokens, held_out) if not h for w in t)
    total = sum(counts.values())
    return [(h, len(t), sum(counts[w] > 0 for w in t), total, sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in t)) for h, t in zip(held_out, tokens)]


def test_op5_counts_and_base_equal_brute_force_and_the_model_beats_it(spark, folder):
    rows = {r.doc_id: r for r in suite.QUERIES["op5_deleted_interpolation_scores"](spark, folder).collect()}
    docs = documents(spark, folder)
    for (d, _), (held, n, known, total, base) in zip(docs, base_scores(docs)):
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_the_model_is_a_distribution(spark):
    """Over all known tokens and one unknown, the probabilities after a context add up to one."""
    weights = np.random.default_rng(0).dirichlet(np.ones(3), lm.BUCKETS)
    counts, pairs = np.array([3, 5, 2]), np.array([1, 0, 1])
    w = weights[lm.bucket(np.array([2]))][0]
    p = w[0] * np.append(pairs, 0) / 2 + w[1] * np.append(counts, 0) / counts.sum() + w[2] / (len(counts) + 1)
    assert math.isclose(p.sum(), 1)


def test_weights_follow_the_held_out_counts():
    import pyarrow as pa

    def cells(pair):
        b = np.array([3, 3])
        return pa.table({"b": b, "p2": lm.bins(np.array(pair)), "p1": lm.bins(np.array([5.0, 0.0])), "n": np.array([90, 10]), "types": np.array([18.0, 10.0])})

    sure = lm.learned(cells([0.9, 0.0]))[2:].reshape(-1, 3)[3]
    poor = lm.learned(cells([0.0, 0.0]))[2:].reshape(-1, 3)[3]
    assert sure[0] > 0.7 and poor[0] < 0.1 and np.isclose(sure.sum(), 1)


def test_odd_documents_are_scored(odd, nothing):
    rows = lm.score(odd).collect()
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted((h, n, k, total, round(b, 6)) for h, n, k, total, b in base_scores(docs))
    assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(math.isfinite(r.score) for r in rows)
    assert lm.score(nothing).count() == 0


def test_op3_equals_sql(spark, folder):
    ok, note, *_ = compare(spark, duck(folder), "op3", suite.QUERIES["op3_mix_sources"], suite.ORACLES["op3_mix_sources"], folder)
    assert ok, note


def test_raking_meets_all_marginals(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", f"l{j}", "t", int(rng.integers(50, 5000))) for i in range(5) for j in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {
        "source": spark.createDataFrame([(f"s{i}", 0.2) for i in range(5)], "source string, target double"),
        "lang": spark.createDataFrame([("l0", 0.5), ("l1", 0.3), ("l2", 0.2)], "lang string, target double"),
        "topic": spark.createDataFrame([("t", 1.0)], "topic string, target double"),
    }
    fitted = mixing.rake(cells, targets).toPandas()
    assert np.allclose(fitted.groupby("source").share.sum(), 0.2, atol=1e-3)
    assert np.allclose(fitted.groupby("lang").share.sum(), [0.5, 0.3, 0.2], atol=1e-6)


def skewed(seed=0, sources=20):
    """Documents of 150 words; the sources follow Zipf's law, and each has languages in proportions of its own."""
    rng, rows = np.random.default_rng(seed), []
    for k in range(sources):
        for n, lang in zip(rng.multinomial(2000 // (k + 1), rng.dirichlet([1, 1, 1, 1])), ("de", "en", "es", "fr")):
            rows += [(len(rows) + i, "w " * 150, f"s{k:02d}", lang) for i in range(n)]
    return rows


def level_shares(raw, rooms):
    """Shares in proportion to ``raw`` that sum to one, none above its room."""
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(rooms, mid * raw).sum() < 1 else (low, mid)
    return np.minimum(rooms, high * raw)


def test_drawn_tokens_of_skewed_sources_meet_the_targets(spark, caplog):
    rows = skewed()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    with caplog.at_level("WARNING"):
        got = mixing.mix(docs).select("_source", "_lang", "_tokens", "_probability", "_copies").toPandas()
    budget = got._tokens.sum() * mixing.FRACTION
    got["expected"], got["drawn"] = got._tokens * got._probability, got._tokens * got._copies
    short = set()
    for c, power in (("_source", 0.5), ("_lang", 0.7)):
        by = got.groupby(c)[["_tokens", "expected", "drawn"]].sum()
        raw = by._tokens**power / (by._tokens**power).sum()
        want = level_shares(raw.to_numpy(), by._tokens.to_numpy() / budget)
        short |= {v for v, w, r in zip(by.index, want, raw) if w < r - 1e-4}
        assert np.allclose(by.expected / budget, want, atol=1e-3)
        assert np.allclose(by.drawn / budget, want, atol=0.02)
    assert math.isclose(got.expected.sum(), budget, rel_tol=1e-9)
    assert (got._probability == 1).any() and got._probability.max() <= 1
    assert short and all(any(f" {v} has" in m for m in caplog.messages) for v in short)


def test_targets_that_no_draw_reaches_still_fill_the_budget(spark):
    """Source a has too few tokens, and only source a has language x: what both lack goes to the rest."""
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 90), ("c", "y", "t", 100)], "source string, lang string, topic string, tokens long")
    even = {
        "source": spark.createDataFrame([("a", 0.4), ("b", 0.3), ("c", 0.3), ("gone", 0.0)], "source string, target double"),
        "lang": spark.createDataFrame([("x", 0.5), ("y", 0.5)], "lang string, target double"),
        "topic": spark.createDataFrame([("t", 1.0)], "topic string, target double"),
    }
    fitted = mixing.rake(cells, even, fraction=0.5)
    assert {r.source: round(r.share, 6) for r in fitted.collect()} == {"a": 0.1, "b": 0.45, "c": 0.45}
    noted = {(r.dimension, r.value): (r.target, round(r.reached, 6)) for r in mixing.reached(fitted, even).collect()}
    assert noted[("source", "a")] == (0.4, 0.1) and noted[("lang", "y")] == (0.5, 0.9) and noted[("source", "gone")] == (0.0, 0.0)


def test_odd_documents_mix(odd, nothing):
    rows = mixing.mix(odd, fraction=0.9).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r._probability <= 1 and r._copies in (0, 1) for r in rows)
    assert all(r._copies == 0 for r in rows if r._tokens == 0)
    assert len({r._copies for r in rows if r.doc_id == 2}) == 1
    assert mixing.mix(nothing).count() == 0
