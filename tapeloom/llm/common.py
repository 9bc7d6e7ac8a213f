"""Helpers of the corpus operators: table sizes, word hashes and the block exchange.

The block exchange answers questions about the whole corpus without sending it anywhere as single rows:
documents are dealt into blocks, each block asks every shard of the hash space one question (a packed
array), each shard answers each block, and the answers meet the block's documents again. What is sent is a
few bytes a distinct item and block, so an item that a third of the corpus holds costs one entry a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import shared_folder

# Bytes of text in one block of the exchange; a block is what one Python call holds at a time.
BLOCK_BYTES = 4 << 20
LEAST_BLOCKS = 24

MULT = 0x9E3779B97F4A7C15
FOLD_CONSTANTS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def keyed(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Columns ``doc_id``, ``body`` (UTF-8 bytes; null text is empty) and those of ``more``, whatever else ``df`` has."""
    return df.select(
        df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("binary"), F.lit(b"")).alias("body"), *[df[c] for c in more]
    )


def carries(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator`` with its carried columns under names of their own inside, so that none meets a column it makes; a carried name
    that the result has too is an error."""

    @wraps(operator)
    def run(df: DataFrame, *args, carry: tuple[str, ...] = (), **named) -> DataFrame:
        if not carry:
            return operator(df, *args, **named)
        held = {f"_carried_{k}": name for k, name in enumerate(carry)}
        out = operator(df.withColumns({k: df[name] for k, name in held.items()}), *args, carry=tuple(held), **named)
        clash = {n.lower() for n in carry} & {n.lower() for n in out.columns}
        if clash:
            raise ValueError(f"carried columns have the names of results: {sorted(clash)}")
        return out.withColumnsRenamed(held)

    return run


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the folder all executors share, and read back."""
    path = f"{shared_folder(df.sparkSession, name)}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def size_of(df: DataFrame, body: str = "body") -> tuple[int, int]:
    """Rows and bytes of text."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(body)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def blocked(docs: DataFrame, n_blocks: int, parts: int | None = None) -> DataFrame:
    """Deal (doc_id, body, ...) into ``n_blocks`` blocks by a hash of id and text, so that repeated ids spread too."""
    block = F.pmod(F.xxhash64("doc_id", F.length("body"), F.crc32("body")), F.lit(n_blocks)).cast("int")
    return docs.withColumn("block", block).repartition(parts or n_blocks, "block")


def blocks_for(n_bytes: int) -> int:
    """Blocks of BLOCK_BYTES; beyond 4 GB of text they grow with its root, so that each still has dozens of items for each shard."""
    each = BLOCK_BYTES * max(1.0, (n_bytes / (4 << 30)) ** 0.5)
    return max(LEAST_BLOCKS, int(-(-n_bytes // each)))


ASK = "shard int, block int, ask binary"


def _asked(t: pa.Table, got: Iterable[tuple[int, bytes]]) -> pa.Table:
    """The questions of a block; one to a negative shard is a note of the block to itself."""
    block = t["block"][0].as_py() if t.num_rows else 0
    got = [(s if s >= 0 else -1 - block, b) for s, b in got] if t.num_rows else []
    return pa.table(
        {"shard": pa.array([s for s, _ in got], pa.int32()), "block": pa.array([block] * len(got), pa.int32()), "ask": pa.array([b for _, b in got], pa.binary())}
    )


def ask(part: DataFrame, question: Callable[[pa.Table], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """One row (shard, block, ask) for each question that ``question`` has about a block's documents."""
    return part.groupBy("block").applyInArrow(lambda t: _asked(t, question(t)), ASK)


def ask_again(part: DataFrame, replies: DataFrame, question: Callable[[pa.Table, dict[int, memoryview]], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """Like ``ask``, with the answers to an earlier question."""
    return use(part, replies, lambda t, r: _asked(t, question(t, r)), ASK)


def answer(asks: DataFrame, serve: Callable[[list[memoryview]], Iterable[bytes]], shards: int) -> DataFrame:
    """One row (block, shard, reply) for each row of ``asks``; ``serve`` sees all questions to one shard. Notes come back as they are."""

    def run(t: pa.Table) -> pa.Table:
        if t["shard"][0].as_py() < 0:
            return t.select(["block", "shard", "ask"]).rename_columns(["block", "shard", "reply"])
        questions = [memoryview(x.as_buffer()) for x in t["ask"]]
        return pa.table({"block": t["block"].combine_chunks(), "shard": t["shard"].combine_chunks(), "reply": pa.array(list(serve(questions)), pa.binary())})

    return asks.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "block int, shard int, reply binary")


def use(part: DataFrame, replies: DataFrame, work: Callable[[pa.Table, dict[int, memoryview]], pa.Table], schema: str) -> DataFrame:
    """``work`` on each block's documents and the replies to it, by shard."""

    def run(docs: pa.Table, got: pa.Table) -> pa.Table:
        by_shard = {s: memoryview(b.as_buffer()) for s, b in zip(got["shard"].to_pylist(), got["reply"])}
        return work(docs, by_shard)

    return part.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def bodies(t: pa.Table, name: str = "body") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and the row boundaries in them."""
    column = t[name].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)) if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64) - int(offsets[0])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FOLD_CONSTANTS[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(FOLD_CONSTANTS[1])
    return x ^ (x >> np.uint64(31))


def power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def rolled(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes of every run of ``width`` values, by doubling; empty when there are fewer."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    out, taken, run, span = None, 0, values.astype(np.uint64), 1
    while True:
        if width & span:
            out = run if out is None else out[: len(run) - taken] * power(base, span) + run[taken:]
            taken += span
        if taken == width:
            return out[: len(values) - width + 1]
        run = run[: len(run) - span] * power(base, span) + run[span:]
        span *= 2


BYTE_TABLES = [mixed(np.arange(1 + 1000 * s, 257 + 1000 * s, dtype=np.uint64) * np.uint64(MULT)) for s in range(2)]
BASES = (0xD1342543DE82EF95, 0xF1357AEA2E62A9C5)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to ``n`` at least; kept for the next block."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        inverse = pow(BASES[seed], -1, 1 << 64)
        span = 1
        while span < size:
            up[span : 2 * span] = up[:span] * power(BASES[seed], span)
            down[span : 2 * span] = down[:span] * power(inverse, span)
            span *= 2
        have = _POWERS[seed] = (up, down)
    return have


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (a run without white space, inside one row), and the first word of each row."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


# Bytes that are hashed in one go; the arrays in between, and the tables of powers that a worker keeps, are eight times as large each.
HASHED = 1 << 18


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from running sums over pieces of the buffer."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + HASHED, side="right")))
        piece = raw[base : int(ends[to - 1])]
        up, down = _powers(seed, len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(BYTE_TABLES[seed][piece] * up[: len(piece)], out=sums[1:])
        first, last = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mixed((sums[last] - sums[first]) * down[first])
        at = to
    return out


def row_pieces(offsets: np.ndarray, size: int = HASHED) -> Iterator[tuple[int, int]]:
    """(from, to) of rows that hold about ``size`` bytes together, or one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, to
        at = to


def inner_starts(rows: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a run of ``width`` items stays in its row; ``rows`` are row boundaries."""
    n = int(rows[-1]) if len(rows) else 0
    keep = np.ones(max(n, 0), bool)
    for back in (rows[1:],):
        lengths = np.diff(rows)
        cut = np.minimum(lengths, width - 1)
        total = int(cut.sum())
        if total:
            at = np.repeat(back - cut, cut) + np.arange(total) - np.repeat(np.cumsum(cut) - cut, cut)
            keep[at] = False
    return np.flatnonzero(keep)


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) over sorted 64-bit keys; a shard is a range of the hash space."""
    if not len(keys):
        return
    edges = [0] + [int(np.searchsorted(keys, np.uint64((s << 64) // shards))) for s in range(1, shards)] + [len(keys)]
    for s in range(shards):
        if edges[s] < edges[s + 1]:
            yield s, edges[s], edges[s + 1]


def slices(batches, size: int = 4 << 20, name: str = "body"):
    """Parts of Arrow batches that hold about ``size`` bytes of text, or one longer row."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = bodies(pa.Table.from_batches([b]), name)[1]
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


def packed(*arrays: np.ndarray) -> bytes:
    """Non-negative integer arrays as byte planes, lowest byte first; planes above the largest value are left out."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, dtype="<u8")
        width = -(-int(a.max()).bit_length() // 8) if len(a) else 0
        out.append(np.array([len(a), width], "<u4").tobytes() + a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return b"".join(out)


def unpacked(blob: memoryview) -> list[np.ndarray]:
    """The arrays of ``packed``, as unsigned 64-bit integers."""
    out, at = [], 0
    while at < len(blob):
        n, width = np.frombuffer(blob[at : at + 8], "<u4").tolist()
        at += 8
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(blob[at : at + n * width], np.uint8).reshape(width, n).T
        out.append(a.reshape(-1).view("<u8"))
        at += n * width
    return out


def deltas(sorted_values: np.ndarray) -> np.ndarray:
    out = sorted_values.astype(np.uint64)
    out[1:] = sorted_values[1:] - sorted_values[:-1]
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a run of ``width`` from one of ``starts``."""
    at = np.bincount(starts, minlength=n).astype(np.int32)
    change = at.copy()
    change[width:] -= at[: max(0, n - width)]
    return np.cumsum(change) > 0
