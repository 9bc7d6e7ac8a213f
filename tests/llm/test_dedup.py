import hashlib

import numpy as np
import pytest

import brute
from tapeloom.llm import sadedup, simhash, sketchdedup, suite
from tapeloom.llm.suffixes import common_prefixes, suffix_array
from test_packing_and_files import documents


def test_suffix_arrays_and_prefixes_equal_sorting():
    rng = np.random.default_rng(5)
    for _ in range(200):
        text = np.append(rng.integers(1, rng.choice([2, 3, 5, 250]), rng.integers(1, 70)), 0).astype(np.uint16)
        order = suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        before, after = common_prefixes(text, order, np.array([0]), len(text))
        for r in range(1, len(text)):
            i, j, k = order[r - 1], order[r], 0
            while text[i + k] == text[j + k]:
                k += 1
            assert before[j] == k == after[i]


def test_op2_equals_brute_force(spark, folder):
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suite.QUERIES["op2_suffix_array_dedup"](spark, folder).collect()}
    docs = documents(spark, folder)
    assert rows == dict(zip([d for d, _ in docs], brute.byte_dedup(docs)))


@pytest.mark.parametrize("length", [4, 30])
def test_short_strings_and_odd_documents_lose_their_repeats(odd, nothing, length):
    rows = odd.where("doc_id IS NULL OR doc_id <> 7").collect()
    want = sorted(brute.byte_dedup([(r.doc_id, r.text) for r in rows], length))
    kept = sadedup.remove_repeats(odd.where("doc_id IS NULL OR doc_id <> 7"), length=length, carry=("source",))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in kept.collect()) == want
    assert sadedup.remove_repeats(nothing).count() == 0


def test_op7_equals_brute_force(spark, folder):
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in suite.QUERIES["op7_sketched_substring_dedup"](spark, folder).collect()}
    docs = documents(spark, folder)
    assert rows == {d: (n, k, hashlib.sha256(x).hexdigest()) for (d, _), (n, k, x) in zip(docs, brute.word_dedup(docs))}


def test_word_windows_of_odd_documents(odd, nothing):
    docs = sorted([(r.doc_id, r.text) for r in odd.collect()], key=lambda r: (r[0] is None, r[0] or 0))
    want = sorted((n, k, x) for n, k, x in brute.word_dedup(docs))
    got = sketchdedup.remove_repeats(odd, carry=("lang", "block_") if "block_" in odd.columns else ("lang",)).collect()
    assert sorted((r.n_words, r.n_removed, bytes(r.kept)) for r in got) == want
    assert sketchdedup.remove_repeats(nothing).count() == 0


def test_a_full_sketch_loses_nothing():
    """Counters that all collide still find every repeat."""
    import pyarrow as pa

    blocks = [pa.table({"doc_id": [k], "tie": [0], "body": pa.array([b"a b c d e f g h"], pa.binary())}) for k in range(3)]
    asks = [dict(sketchdedup.sketch_asks(t, 4, 1, 1)) for t in blocks]
    for t, reply in zip(blocks, sketchdedup.merge_sketches([memoryview(a[0]) for a in asks], 1)):
        _, _, (h,) = sketchdedup.window_hashes(t, 4, 1)
        assert sketchdedup.estimated_repeated(h, {0: memoryview(reply)}, 1, 1).all()


def test_op6_equals_brute_force(spark, folder):
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in suite.QUERIES["op6_simhash_near_duplicates"](spark, folder).collect()}
    docs = documents(spark, folder)
    f = [brute.simhash(x) for _, x in docs]
    up = brute.components(len(docs), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    assert rows == {d: (f"{x:016x}", docs[u][0]) for (d, _), x, u in zip(docs, f, up)}


@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_bit_sliced_comparison_finds_all_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = np.unique(np.concatenate([b ^ np.array([sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 10), False)) for _ in range(25)], np.uint64) for b in base]))
    i, j = simhash.within(values, simhash.planes_of(values), len(values), radius)
    want = {(a, b) for a in range(len(values)) for b in range(len(values)) if int(values[a] ^ values[b]).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_chains_and_large_buckets_of_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    values = [(1 << k) - 1 for k in range(60)] + [(0xFFFF << 40) ^ (1 << k) for k in range(30)]
    fps = spark.createDataFrame([(v,) for v in sorted(set(values))], "fp long")
    from tapeloom.llm.graph import components

    got = {r.node: r.component for r in components(simhash.links(fps, 4)).collect()}
    f = sorted(set(values))
    up = brute.components(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    assert {v: f[u] for v, u in zip(f, up) if up.count(u) > 1} == got


def test_fingerprints_of_odd_documents(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    want = sorted(f"{brute.simhash(r.text):016x}" for r in odd.collect())
    assert sorted(r.fingerprint for r in rows) == want
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3}
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 8)} == {1}
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").count() == 0


def test_each_component_keeps_its_row_when_an_id_has_two_texts(spark):
    """Id 1 has a copy of a document of id 0 and a text of its own; id 5 has two texts and copies of both."""
    a, b, c, d = (" ".join(f"{w}{k}" for k in range(80)) for w in ("ash", "birch", "cedar", "dogwood"))
    f = [brute.simhash(x) for x in (a, b, c, d)]
    assert all((x ^ y).bit_count() > 4 for i, x in enumerate(f) for y in f[:i])
    rows = [(0, a), (1, a), (1, b), (5, c), (5, d), (5, c), (6, d), (7, c), (None, a)]
    for order in (rows, rows[::-1]):
        kept = simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()
        assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(0, a), (1, b), (5, c), (5, d), (None, a)], key=str)
