import hashlib
import math
from collections import Counter

import numpy as np
import pytest

import brute
import corpus_pipeline
from tapeloom.llm import langid, sketchdedup
from tapeloom.llm.common import fold
from test_models import level_shares
from test_packing_and_files import check_places

STAGES = dict(corpus_pipeline.STAGES)
EXTRA = ("block", "tie", "body", "score", "kept", "n_words", "first", "component", "tokens", "share", "room")


@pytest.fixture(scope="module")
def clashing(odd):
    """The odd documents with columns named like the operators' own, whose values tell the rows apart."""
    rows = [(*r[:5], *(f"{name} {k}" for name in EXTRA)) for k, r in enumerate(odd.collect())]
    return odd.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in EXTRA))


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_language_id_keeps_whole_rows_of_one_language(spark, clashing):
    got = STAGES["language_id"](spark, clashing, "")
    langs, model = langid.learn(clashing.where(fold("doc_id", 5) != 0), "lang", "doc_id", "text")
    want = []
    for r in clashing.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        share = langid.mixtures(raw, np.array([0, len(raw)]), model)[0]
        if any(x.isalpha() for x in r.text or "") and share.max() >= 0.5:
            want.append(tuple(r))
    assert got.columns == clashing.columns and plain(got) == sorted(want, key=str) and 0 < len(want) < clashing.count()


def test_near_dedup_keeps_the_first_row_of_each_component(spark, clashing):
    rows = clashing.collect()
    f = [brute.simhash(r.text) for r in rows]
    up = brute.components(len(rows), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    first = {}
    for r, u in zip(rows, up):
        if r.doc_id is not None:
            first[u] = min(first.get(u, r.doc_id), r.doc_id)
    got = STAGES["near_dedup"](spark, clashing, "")
    assert got.columns == clashing.columns and set(plain(got)) <= {tuple(r) for r in rows}
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted([str(x) for x in first.values()] + ["None"] * sum(r.doc_id is None for r in rows))


def test_substring_dedup_equals_brute_force(spark, clashing):
    rows = sorted(clashing.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    want = []
    for r, (n, gone, kept) in zip(rows, brute.word_dedup([(r.doc_id, r.text) for r in rows])):
        if not n or gone < n:
            text = kept.decode() if gone else r.text or ""
            want.append({**r.asDict(), "text": text, "n_chars": len(text)})
    got = STAGES["substring_dedup"](spark, clashing, "")
    assert got.columns == clashing.columns
    assert plain(got) == sorted((tuple(w.values()) for w in want), key=str)


def test_carried_columns_keep_their_values_or_are_refused(clashing):
    got = sketchdedup.remove_repeats(clashing, carry=("block", "tie", "body", "score"))
    assert plain(got.select("block", "tie", "body", "score")) == plain(clashing.select("block", "tie", "body", "score"))
    with pytest.raises(ValueError, match="kept"):
        sketchdedup.remove_repeats(clashing, carry=("kept",))


def test_mix_sources_draws_what_the_shares_say(spark, clashing):
    sizes = {"s0": 60, "s1": 20, "s2": 5, "s3": 1}
    rows = [(100 * k + i, "w " * 10, "en", s, 20, *(f"{x} {k} {i}" for x in EXTRA)) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(900, None, "en", "s0", 0, *EXTRA), (901, "", None, None, 0, *EXTRA)]
    got = STAGES["mix_sources"](spark, spark.createDataFrame(rows, clashing.schema), "")
    n = np.array(list(sizes.values()), float)
    share = level_shares(n**0.5 / (n**0.5).sum(), n / (0.5 * n.sum()))
    chance = dict(zip(sizes, np.minimum(1, share * 0.5 * n.sum() / n)))
    assert math.isclose(sum(chance[s] * sizes[s] for s in sizes), 0.5 * n.sum()) and chance["s3"] == 1
    drawn = [r for r in rows if r[1] and int(hashlib.md5(str(r[0]).encode()).hexdigest()[:8], 16) / 2**32 < chance[r[3]]]
    assert got.columns == clashing.columns and plain(got) == sorted(drawn, key=str)


def packed(docs):
    want = Counter()
    for (d, _), x in zip(docs, brute.ids(docs, 0)):
        want.update((d, k // 2048, k, len(x[k : k + 2048]), brute.crc(x[k : k + 2048])) for k in range(0, len(x), 2048))
    return want


def test_pack_holds_every_token_once(spark, clashing):
    got = STAGES["pack"](spark, clashing, "").collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == packed([(r.doc_id, r.text) for r in clashing.collect()])
    check_places(got, 2048)


def test_run_is_its_stages_one_after_the_other(spark, clashing, tmp_path):
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = clashing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), clashing.schema)
    # A row of several equal in id and text may stand for the others.
    assert got and Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == packed([(r.doc_id, r.text) for r in docs.collect()])
    check_places(got, 2048)


def test_empty_tables_stay_empty(spark, clashing, tmp_path):
    none = clashing.where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
