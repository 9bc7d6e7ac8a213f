"""Substring deduplication of word windows behind a count-min sketch.

First pass: every block of documents counts its windows in a sketch of its own, cut into shards by the
windows' hashes; shards merge the blocks' sketches by adding, so merged counters never undercount a window.
A block gets back which of its counters reached two. Second pass: only windows all of whose counters
did are grouped, by 96-bit hashes of their words, to find where each starts first. All windows that start later
go with the words they cover.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import common as c

# Rows of counters in a sketch, and counters a window.
DEPTH = 2
LOAD = 8


def window_hashes(t: pa.Table, width: int, seeds: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(first word of each document, start of each window, hashes of each window by seed)."""
    raw, offsets = c.bodies(t)
    starts, ends, rows = c.word_bounds(raw, offsets)
    at = c.inner_starts(rows, width)
    return rows, at, [c.mixed(c.rolled(c.word_hashes(raw, starts, ends, s), width, c.BASES[1 - s])[at]) if len(at) else np.zeros(0, np.uint64) for s in range(seeds)]


def in_order(t: pa.Table) -> pa.Table:
    return t.sort_by([("doc_id", "ascending"), ("tie", "ascending")])


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes * np.uint64(c.FOLD_CONSTANTS[row % 2] + 2 * (row // 2))) >> np.uint64(20)) & np.uint64((1 << bits) - 1)


def sketch_asks(t: pa.Table, width: int, shards: int, bits: int):
    """A block's sketch, shard by shard: the counters it adds to, one entry for each of its windows."""
    _, _, (h,) = window_hashes(in_order(t), width, 1)
    h = np.sort(h)
    for shard, low, high in c.by_shard(h, shards):
        yield shard, c.packed(*[c.deltas(np.sort(cells(h[low:high], row, bits))) for row in range(DEPTH)])


def merge_sketches(asks: list[memoryview], bits: int):
    """The merged counters of a shard, answered as one bit for each entry asked about: reached two or not."""
    rows = [[np.cumsum(x) for x in c.unpacked(blob)] for blob in asks]
    counts = [np.bincount(np.concatenate([r[row] for r in rows]).astype(np.int64), minlength=1 << bits) for row in range(DEPTH)]
    for r in rows:
        yield b"".join(np.packbits(counts[row][r[row].astype(np.int64)] >= 2).tobytes() for row in range(DEPTH))


def estimated_repeated(h: np.ndarray, replies: dict[int, memoryview], shards: int, bits: int) -> np.ndarray:
    """Which windows have all counters at two or more."""
    order = np.argsort(h, kind="stable")
    out = np.ones(len(h), bool)
    for shard, low, high in c.by_shard(h[order], shards):
        size = -(-(high - low) // 8)
        for row in range(DEPTH):
            mine = np.argsort(cells(h[order[low:high]], row, bits), kind="stable")
            got = np.unpackbits(np.frombuffer(replies[shard][row * size : (row + 1) * size], np.uint8), count=high - low)
            out[order[low:high][mine]] &= got.astype(bool)
    return out


def first_keys(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first occurrence of each distinct pair, in order of the pairs."""
    order = np.lexsort((b, a))
    head = np.ones(len(order), bool)
    head[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order[head], order


def exact_asks(t: pa.Table, replies: dict[int, memoryview], width: int, shards: int, bits: int):
    """The distinct windows of a block that are estimated repeated: key and first document; and a note of which these are."""
    t = in_order(t)
    rows, at, (a, b) = window_hashes(t, width, 2)
    marked = estimated_repeated(a, replies, shards, bits)
    b = b >> np.uint64(32)
    yield -1, np.packbits(marked).tobytes()
    at, a, b = at[marked], a[marked], b[marked]
    first, _ = first_keys(a, b)
    doc = np.searchsorted(rows, at[first], side="right") - 1
    ids = t["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy().astype(np.int64).view(np.uint64)
    ties = t["tie"].to_numpy().view(np.uint64)
    for shard, low, high in c.by_shard(a[first], shards):
        used, of = np.unique(doc[low:high], return_inverse=True)
        yield shard, c.packed(c.deltas(a[first][low:high]), b[first][low:high], of, ids[used], ties[used])


def exact_firsts(asks: list[memoryview]):
    """For each block, which of its windows start nowhere earlier in another block."""
    parts = [c.unpacked(blob) for blob in asks]
    a = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    b = np.concatenate([p[1] for p in parts])
    ids = np.concatenate([p[3][p[2].astype(np.int64)] for p in parts]).view(np.int64)
    ties = np.concatenate([p[4][p[2].astype(np.int64)] for p in parts]).view(np.int64)
    order = np.lexsort((ties, ids, b, a))
    head = np.ones(len(order), bool)
    head[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    first = np.zeros(len(order), bool)
    first[order[head]] = True
    at = 0
    for p in parts:
        yield np.packbits(first[at : at + len(p[0])]).tobytes()
        at += len(p[0])


def kept_words(t: pa.Table, replies: dict[int, memoryview], width: int, shards: int, carry: list[str], spare: bool) -> pa.Table:
    """Each document's words outside the windows that start earlier elsewhere."""
    t = in_order(t)
    rows, at, (a, b) = window_hashes(t, width, 2)
    note = next(r for s, r in replies.items() if s < 0)
    marked = np.unpackbits(np.frombuffer(note, np.uint8), count=len(at)).astype(bool)
    at, a, b = at[marked], a[marked], b[marked] >> np.uint64(32)
    first, _ = first_keys(a, b)
    removed = np.ones(len(at), bool)
    for shard, low, high in c.by_shard(a[first], shards):
        got = np.unpackbits(np.frombuffer(replies[shard], np.uint8), count=high - low).astype(bool)
        removed[first[low:high][got]] = False
    gone = c.covered(at[removed], width, int(rows[-1]) if len(rows) else 0)
    texts, n_removed = [], []
    for k, body in enumerate(t["body"]):
        mine = gone[rows[k] : rows[k + 1]]
        text = body.as_buffer().to_pybytes()
        n_removed.append(int(mine.sum()))
        if n_removed[-1]:
            text = b" ".join([w for w, g in zip(text.split(), mine.tolist()) if not g])
        texts.append(text if n_removed[-1] or spare else b" ".join(text.split()))
    out = {n: t[n] for n in ["doc_id", *carry]}
    out |= {"n_words": pa.array(np.diff(rows)), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(texts, pa.binary())}
    return pa.table(out)


@c.carries
def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, carry: tuple[str, ...] = (), spare: bool = False) -> DataFrame:
    """(doc_id, carried columns, n_words, n_removed, kept) of every row: ``kept`` has the UTF-8 words that stay, joined by one space;
    with ``spare``, a text that loses nothing keeps its white space.

    A window of ``width`` words goes if the same words start earlier: in a smaller id, or earlier in the document. The id
    must be an integer; null ids count as the largest. Rows of one id count in order of a hash of their text, equal
    rows one after the other. Null and empty texts have no words. An empty table gives an empty result. Columns of ``df``
    that are not named are not read.
    """
    docs = c.keyed(df, id_col, text_col, *carry).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("tie", F.xxhash64("body"))
    _, size = c.size_of(docs)
    n = c.blocks_for(size)
    bits = max(10, int(np.ceil(np.log2(LOAD * max(1, size // 6) / n + 1))))
    part = c.blocked(docs, n)
    sketches = c.answer(c.ask(part, lambda t: sketch_asks(t, width, n, bits)), lambda q: merge_sketches(q, bits), n)

    again = c.ask_again(part, sketches, lambda t, r: exact_asks(t, r, width, n, bits))
    exact = c.answer(again, exact_firsts, n)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*carry).schema) if carry else ""
    return c.use(part, exact, lambda t, r: kept_words(t, r, width, n, list(carry), spare), f"doc_id long, {kinds}n_words long, n_removed long, kept binary")
