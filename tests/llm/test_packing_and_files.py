import numpy as np
import pytest

import brute
from tapeloom.llm import packing, suite, tokenfile
from tapeloom.llm.tokens import encoder
from tapeloom.session import shared_folder


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()]


def test_encoder_equals_the_tokenizer_on_odd_texts():
    odd = ["It's I'M don'T x'll'd", "ÀÉ straße ẞ İstanbul ΣΑΣ", "a<|endoftext|>b", "½²ªº", "é a", "1234 $$%\x1f\x0b\x0c\x85 ", "", "   ", "_a_b", "naïve'RE ×÷"]
    t, e = brute.tokenizer(), encoder()
    rng = np.random.default_rng(0)
    odd += ["".join(rng.choice(list("aAzZéÉßÿ0'strevmld <>|_-\n\t.À×"), 25)) for _ in range(3000)]
    for x in odd:
        assert np.frombuffer(e.encode(x), np.uint32).tolist() == t.encode(x, add_special_tokens=False).ids, x


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_op1_equals_brute_force(spark, folder):
    rows = suite.QUERIES["op1_best_fit_packing"](spark, folder).collect()
    docs = documents(spark, folder)
    want = {}
    for (d, _), x in zip(docs, brute.ids(docs, 0)):
        for k in range(0, len(x), 2048):
            want[d, k // 2048] = (k, len(x[k : k + 2048]), brute.crc(x[k : k + 2048]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert check_places(rows, 2048) <= brute.best_fit_decreasing([r.length for r in rows], 2048)


def test_op10_equals_brute_force(spark, folder):
    rows = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in suite.QUERIES["op10_token_files"](spark, folder).collect()}
    docs, at = documents(spark, folder), 0
    for (d, _), x in zip(docs, brute.ids(docs, 2)):
        assert rows[d] == (at, len(x), brute.crc(x))
        at += len(x)
    assert len(rows) == len(docs)


@pytest.mark.parametrize("n", [1, 7, 400, 5000])
def test_plan_places_every_length_once_and_packs_as_well_as_best_fit(n):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(6, 1, n).astype(int), 1, 2048)
    plan = packing.plan(np.bincount(lengths, minlength=2049), 2048)
    used = np.zeros(plan.sequences, int)
    seen = np.zeros(2049, int)
    for length, low, high, first, offset in sorted(plan.runs, key=lambda r: r[4]):
        seen[length] += high - low
        assert (used[first : first + high - low] == offset).all()
        used[first : first + high - low] += length
    assert (seen == np.bincount(lengths, minlength=2049)).all() and used.max() <= 2048
    assert plan.sequences <= brute.best_fit_decreasing(lengths.tolist(), 2048)


def test_configurations_cover_the_demand():
    sizes, demand = np.array([900, 700, 500, 300]), np.array([40.0, 35, 50, 60])
    columns, times = packing.configurations(sizes, demand, 2048)
    assert (times > -1e-6).all() and (sizes @ columns <= 2048 + 1e-6).all()
    assert np.allclose(columns @ times, demand)
    assert times.sum() >= sizes @ demand / 2048 - 1e-6


def test_odd_documents_pack(odd, nothing):
    rows = packing.pack_documents(odd, capacity=64, with_ids=True).collect()
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert sum(r.length for r in rows) == sum(map(len, brute.ids(docs, 0)))
    assert all(len(r.ids) == r.length and brute.crc(r.ids) == r.ids_crc32 for r in rows)
    check_places(rows, 64)
    assert packing.pack_documents(nothing).count() == 0


def test_lengths_that_do_not_fit_have_no_place(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 0), (4, 11), (5, 10)], "k long, n long")
    got = {r.k: r.sequence_id for r in packing.pack(df, "n", 10, ["k"]).collect()}
    assert {k for k, s in got.items() if s is None} == {2, 3, 4}


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_are_ordered_and_read_selectively(spark, odd, nothing, encoding):
    path = f"{shared_folder(spark, 'files')}/t"
    tokenfile.write_tokens(odd, path, encoding=encoding)
    stored = spark.read.parquet(path).orderBy("part", "start_in_part").collect()
    ids = [r.doc_id for r in stored]
    assert ids == sorted(ids, key=lambda x: (x is not None, x)) and len(ids) == odd.count()
    assert sorted((r.start, r.n_tokens) for r in tokenfile.digests(spark, path).collect()) == sorted((r.start, r.n_tokens) for r in tokenfile.read_metadata(spark, path).collect())
    part = tokenfile.read_tokens(spark, path, 6, 8)
    assert sorted(r.doc_id for r in part.collect()) == [6, 7, 8]
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,6)" in part._jdf.queryExecution().toString()
    empty = f"{shared_folder(spark, 'files')}/t"
    tokenfile.write_tokens(nothing, empty)
    assert tokenfile.digests(spark, empty).count() == 0
