"""Resampling, fill-in-the-middle and chat formatting."""

import hashlib
import math
import os
import re
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import chat, fim, resample, suite
from test_packing_and_files import documents

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle_compare import compare, duck  # noqa: E402


@pytest.mark.parametrize("name", ["op11_target_resampling", "op12_fill_in_middle", "op13_chat_formatting"])
def test_query_equals_sql(spark, folder, name):
    ok, note, *_ = compare(spark, duck(folder), name, suite.QUERIES[name], suite.ORACLES[name], folder)
    assert ok, note


FEATURE = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hashed_features(text):
    w = FEATURE.findall((text or "").encode().lower())
    return len(w), [zlib.crc32(f) % 10000 for f in [*w, *(a + b" " + b for a, b in zip(w, w[1:]))]]


def resampled(rows, targets, least=20, percent=25):
    """[(doc_id, n_features, weight, score, rank)] by plain loops, ids distinct or null."""
    docs = [(d, *hashed_features(x)) for d, x in rows]
    s, t = [0] * 10000, [0] * 10000
    for held, sums in ((docs, s), ([(0, *hashed_features(x)) for x in targets], t)):
        for _, _, fs in held:
            for f in fs:
                sums[f] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out = []
    for d, n, fs in docs:
        weight = sum(gain[f] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling_equals_brute_force(spark, folder):
    targets = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = suite.QUERIES["op11_target_resampling"](spark, folder).collect()
    assert sorted((tuple(r) for r in got), key=str) == resampled(documents(spark, folder), targets)


def test_resampling_of_odd_documents(spark, odd, nothing):
    target = spark.createDataFrame([("word1 and1 word2",), (None,), ("",)], "text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for options in ({}, {"chunk_rows": 3, "digit_bits": 2}):
        got = resample.resample(odd, target, percent=100, **options).collect()
        assert sorted((tuple(r) for r in got), key=str) == resampled(rows, ["word1 and1 word2"], percent=100)
    assert resample.resample(nothing, target).count() == 0
    assert resample.resample(odd, target.limit(0)).count() == len(rows)


@given(st.lists(st.text(alphabet="aZ9é€ .\x00\n_", max_size=200), max_size=6), st.integers(0, 80))
@settings(max_examples=80, deadline=None)
def test_features_equal_a_plain_loop(texts, tail):
    texts = [*texts, "x" * tail + " y " + "z" * (tail + 30)]
    parts = [x.encode() for x in texts]
    ends = np.cumsum([0, *map(len, parts)])
    words, count, found = resample.features(np.frombuffer(b"".join(parts), np.uint8), ends)
    at = 0
    for x, n, c in zip(texts, words, count):
        assert (n, found[at : at + c].tolist()) == hashed_features(x)
        at += c


def test_radix_sort_equals_sorting(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i) if i % 9 else None, 1, 0, int(s)) for i, s in zip(rng.integers(-(1 << 62), 1 << 62, 500), rng.integers(-40, 40, 500))]
    rows += rows[:50] + [(7 * k + 1, 2, 0, 5) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long")
    got = [(r.doc_id, r.score) for r in resample.ranked(df, chunk_rows=64, digit_bits=12).orderBy("rank").collect()]
    assert got == sorted(((r[0], r[3]) for r in rows), key=lambda r: (-r[1], r[0] is None, r[0] or 0))


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def rearranged(d, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    t = TOKEN.findall(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(t), "plain", None, None, text
    a, b = sorted(x % (len(t) + 1) for x in h[:2])
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if h[3] % 100 < 80:
        return len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rearranged_odd_documents_and_their_restoration(spark, odd, nothing):
    marks = spark.createDataFrame([(20 + k, x) for k, x in enumerate(["a <P> b", "<S", "<<M", "x <", "M> y P>", " lead", "trail \n", "é€\U0001f600 z"] * 12)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(marks)
    got = fim.rearrange(docs, restore=True)
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode()) for r in got.drop("restored").collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, *rearranged(r.doc_id, r.text)) for r in docs.collect())
    assert list(map(str, rows)) == list(map(str, want))
    assert {r[3] for r in rows} == {"plain", "psm", "spm"}
    texts = sorted(r.text or "" for r in docs.collect())
    assert sorted(bytes(r.restored).decode() for r in got.collect()) == texts
    assert sorted(r.text for r in fim.restore(got, carry=("doc_id",)).collect()) == texts
    assert fim.rearrange(nothing, restore=True).count() == 0


@given(st.lists(st.tuples(st.text(alphabet="ab <PSM>é\n", max_size=60), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4)), max_size=8), st.sampled_from([3, 7, 1 << 20]))
@settings(max_examples=150, deadline=None)
def test_pieces_of_any_size_give_the_same(rows, piece):
    before, fim.PIECE = fim.PIECE, piece
    try:
        parts = [x.encode() for x, _ in rows]
        raw, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]).astype(np.int64)
        got = fim.transformed(raw, ends, np.array([h for _, h in rows], np.int64).reshape(-1, 4))
        assert fim.gather(got["out"], got["rows"], got["form"]).tobytes() == raw.tobytes()
        assert got["n"].tolist() == [len(TOKEN.findall(x)) for x, _ in rows]
    finally:
        fim.PIECE = before


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


ODD_TURNS = [
    (1, 0, "user", "a<|b<\\|c<\\\\|"),
    (1, 1, "assistant", "<"),
    (1, 2, "user", None),
    (1, 3, "assistant", "\\|x<|im_end|>\n"),
    (None, None, None, None),
    (None, 2, "user", "no id"),
    (2, 0, "assistant", "x"),
    (2, 0, "assistant", "x"),
    (2, 0, "we\nird <|r", "y"),
    (3, 5, "system", ""),
    (3, 6, "user", "hi " * 20000),
    (3, 7, "assistant", "calls"),
    (3, 8, "tool", "{}"),
    (3, 9, "assistant", "done"),
    (4, 0, "user", "only asks"),
]


def test_odd_conversations_are_read_back_whatever_their_parts(spark):
    df = talk(spark, ODD_TURNS)
    groups = {}
    for c, t, r, x in ODD_TURNS:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or "", r))
    for part_turns in (chat.PART_TURNS, 2, 1):
        parts = chat.format_conversations(df.withColumn("part", df.turn), part_turns=part_turns)
        assert parts.agg({"n_turns": "max"}).first()[0] <= part_turns
        got = {r.conv_id: r for r in chat.read_back(parts).collect()}
        assert set(got) == set(groups)
        for c, turns in groups.items():
            turns.sort(key=lambda t: t[:4])
            assert got[c].turns_text == "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
            assert got[c].loss_text == "".join(t[3] for t in turns if t[4] == "assistant")
            assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(got[c].loss_text))
        assert {c: (r.in_order, r.complete) for c, r in got.items()} == {1: (True, True), None: (False, False), 2: (False, False), 3: (True, True), 4: (True, False)}


def test_flags_lie_on_assistant_texts_and_no_conversation_is_empty(spark):
    parts = chat.format_conversations(talk(spark, ODD_TURNS)).where("conv_id = 1").first()
    assert [s.text for s in parts.segments if s.loss] == ["<", "\\|x<\\|im_end|>\n"]
    assert "".join(s.text for s in parts.segments).count("<|") == 8
    assert chat.read_back(chat.format_conversations(talk(spark, []))).count() == 0


def test_a_template_of_its_own(spark):
    plain = chat.Template((("[{role}]\n", False), ("{text}", True), ("<|stop|>", False)), ("bot",), {(chat.START, "bot"): "said", ("said", "bot"): "said"}, ("said",))
    df = talk(spark, [(1, 0, "bot", "<|stop|>"), (1, 1, "bot", "b"), (2, 0, "user", "c")])
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df, plain), plain).collect()}
    assert got[1].turns_text == "bot\n<|stop|>\nbot\nb\n" and got[1].loss_text == "<|stop|>b" and got[1].complete
    assert not got[2].in_order and got[2].loss_text == ""
