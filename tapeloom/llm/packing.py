"""Best-fit packing with a linear grouping scheme.

The plan works on the histogram of lengths, which has at most ``capacity`` entries whatever the data's size:
large lengths are grouped into equal-cardinality groups and rounded up to the largest of their group; a
configuration program (columns priced by a knapsack) packs the few rounded sizes; actual lengths then take
the rounded places, and what is left, the small lengths above all, goes best-fit into the free space. A plan
is a list of runs (length, ranks from-to, first sequence, offset), and each row finds its run by its rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import keyed, table
from tapeloom.llm.tokenfile import token_batches
from tapeloom.llm.tokens import VOCABULARY

# Rows of one length are ranked in so many separate groups, so that a frequent length is no single task.
SALTS = 64
GROUPS = 40
# Lengths up to this share of the capacity count as small; each is tried.
SMALL = (0.4, 0.5)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Columns (counts of each size in one sequence) and how often to use each, by column generation."""
    g = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x = inverse @ demand
        price = inverse.sum(axis=0)
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(sizes.min()), capacity + 1):
            fits = sizes <= room
            gain = np.where(fits, best[room - np.minimum(sizes, room)] + price, -1.0)
            k = int(gain.argmax())
            if gain[k] > best[room - 1]:
                best[room], pick[room] = gain[k], k
            else:
                best[room] = best[room - 1]
        if best[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(g), capacity
        while room > 0:
            if pick[room] < 0:
                room -= 1
            else:
                column[pick[room]] += 1
                room -= int(sizes[pick[room]])
        step = inverse @ column
        ratio = np.where(step > 1e-12, x / np.where(step > 1e-12, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    return basis, np.linalg.solve(basis, demand)


def plan(counts: np.ndarray, capacity: int, groups: int = GROUPS) -> "Plan":
    """The plan with the fewest sequences among those that count lengths as small up to different bounds."""
    return min((Plan(counts, capacity, groups, small) for small in SMALL), key=lambda p: p.sequences)


class Plan:
    """Runs of equal lengths; ``counts[l]`` rows have length l."""

    def __init__(self, counts: np.ndarray, capacity: int, groups: int = GROUPS, small: float = 0.125):
        self.capacity, self.left, self.sequences = capacity, counts.astype(np.int64).copy(), 0
        self.next_rank = np.zeros(capacity + 1, np.int64)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.free: dict[int, list[tuple[int, int]]] = {}
        whole = int(self.left[capacity])
        if whole:
            self._put(capacity, whole, self._open(whole), 0)
        self._large(groups, int(capacity * small))
        for length in range(capacity, 0, -1):
            self._best_fit(length)

    def _open(self, n: int) -> int:
        first = self.sequences
        self.sequences += n
        return first

    def _put(self, length: int, n: int, first: int, offset: int) -> None:
        """The next ``n`` rows of a length go to the sequences from ``first`` on, one each."""
        rank = int(self.next_rank[length])
        self.runs.append((length, rank, rank + n, first, offset))
        self.next_rank[length] += n
        self.left[length] -= n

    def _room(self, used: int, first: int, n: int) -> None:
        if n and used < self.capacity:
            self.free.setdefault(self.capacity - used, []).append((first, n))

    def _large(self, groups: int, small: int) -> None:
        lengths = np.arange(self.capacity, small, -1)
        counts = self.left[lengths]
        lengths, counts = lengths[counts > 0], counts[counts > 0]
        total = int(counts.sum())
        if not total:
            return
        each = -(-total // groups)
        queues, ends = [], np.cumsum(counts)
        for low in range(0, total, each):
            high = min(total, low + each)
            share = np.minimum(ends, high) - np.maximum(ends - counts, low)
            queues.append([[int(v), int(n)] for v, n in zip(lengths, share) if n > 0])
        sizes = np.array([q[0][0] for q in queues])
        demand = np.array([sum(n for _, n in q) for q in queues], float)
        merged = np.unique(sizes)[::-1]
        need = np.array([demand[sizes == s].sum() for s in merged])
        columns, times = configurations(merged, need, self.capacity)
        by_size = {int(s): [run for q in queues if q[0][0] == s for run in q] for s in merged}
        for c in range(len(merged)):
            n = int(times[c] + 1e-9)
            slots = [int(s) for k, s in enumerate(merged) for _ in range(int(round(columns[k, c])))]
            if n and slots:
                self._configuration(slots, n, by_size)

    def _configuration(self, slots: list[int], n: int, queues: dict[int, list[list[int]]]) -> None:
        """``n`` sequences with a place for each of ``slots``; runs of actual lengths take the places."""
        taken = []
        for s in slots:
            need, runs = n, []
            while need and queues[s]:
                length, have = queues[s][0]
                k = min(need, have)
                runs.append((length, k))
                need -= k
                queues[s][0][1] -= k
                if not queues[s][0][1]:
                    queues[s].pop(0)
            if need:
                runs.append((0, need))
            taken.append(runs)
        first = self._open(n)
        cuts = sorted({0, *(int(x) for runs in taken for x in np.cumsum([k for _, k in runs]))})
        at = [0] * len(taken)
        ends = [np.cumsum([k for _, k in runs]).tolist() for runs in taken]
        for low, high in zip(cuts[:-1], cuts[1:]):
            used = 0
            for k, runs in enumerate(taken):
                while ends[k][at[k]] <= low:
                    at[k] += 1
                length = runs[at[k]][0]
                if length:
                    self._put(length, high - low, first + low, used)
                    used += length
            self._room(used, first + low, high - low)

    def _best_fit(self, length: int) -> None:
        while self.left[length]:
            room = min((f for f in self.free if f >= length), default=0)
            n = int(self.left[length])
            each = (room or self.capacity) // length
            if room:
                first, bins = self.free[room].pop()
                if not self.free[room]:
                    del self.free[room]
            else:
                room, bins = self.capacity, -(-n // each)
                first = self._open(bins)
            full = min(bins, n // each)
            used = self.capacity - room
            for k in range(each if full else 0):
                self._put(length, full, first, used + k * length)
            self._room(used + each * length, first, full)
            rest = min(n - full * each, each) if full < bins else 0
            for k in range(rest):
                self._put(length, 1, first + full, used + k * length)
            if rest:
                self._room(used + rest * length, first + full, 1)
                full += 1
            self._room(used, first + full, bins - full)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted by (length, rank): keys, first ranks, first sequences, offsets."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return (runs[:, 0] << 44) + runs[:, 1], runs[:, 1], runs[:, 3], runs[:, 4]


def pack(df: DataFrame, length_col: str, capacity: int, order: list[str], groups: int = GROUPS) -> DataFrame:
    """``df`` with sequence_id and offset: rows packed by length into sequences of at most ``capacity``.

    ``df`` must be stored (it is read twice). ``order`` makes equal lengths take their places in a fixed order;
    rows equal in it are interchangeable. Rows whose length is null or outside 1..capacity get nulls. The driver
    holds the histogram and the plan: at most ``capacity`` lengths times SALTS counts.
    """
    fits = F.col(length_col).between(1, capacity)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int")).withColumn("_length", F.when(fits, F.col(length_col)).cast("int"))
    base = np.zeros((capacity + 1, SALTS), np.int64)
    for row in salted.where("_length IS NOT NULL").groupBy("_length", "_salt").count().toLocalIterator():
        base[row[0], row[1]] = row[2]
    keys, ranks, firsts, offsets = plan(base.sum(axis=1), capacity, groups).arrays()
    base = np.cumsum(base, axis=1) - base
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("_length", "_salt").orderBy(*order)) - 1)
    names = [c for c in ranked.columns if c not in ("_salt", "_length", "_rank")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", sequence_id long, offset long"

    def run(batches):
        for b in batches:
            ok = b["_length"].is_valid().to_numpy(zero_copy_only=False)
            length = b["_length"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = base[length, b["_salt"].to_numpy()] + b["_rank"].to_numpy()
            at = np.maximum(np.searchsorted(keys, (length << 44) + rank, side="right") - 1, 0)
            place = (firsts[at] + rank - ranks[at], offsets[at]) if len(keys) else (rank, rank)
            yield pa.RecordBatch.from_arrays(
                [b[n] for n in names] + [pa.array(p, pa.int64(), mask=~ok) for p in place], [*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(run, schema)


def pieces(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str = VOCABULARY, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and an end id, cut only where longer
    than ``capacity``. Null text is empty: the end id alone."""
    docs = keyed(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for rows, counts, ids in token_batches(batches, vocabulary, end_id):
            cuts = -(-counts // capacity)
            of = np.repeat(np.arange(len(counts)), cuts)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(counts[of] - start, capacity)
            at = (np.cumsum(counts) - counts)[of] + start
            view = memoryview(ids)
            blobs = [view[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
            out = {
                "doc_id": rows["doc_id"].take(pa.array(of)),
                "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(x) for x in blobs], pa.int64()),
            }
            if with_ids:
                flat = pa.Array.from_buffers(pa.int32(), len(ids) // 4, [None, pa.py_buffer(ids)])
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids) // 4).astype(np.int32)), flat)
            yield pa.RecordBatch.from_pydict(out)

    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """The pieces of every document with the sequence and the place there that hold them.

    Null and empty texts are the end id alone. Repeated ids and rows are documents of their own; null ids are
    kept. An empty table gives an empty result. Other columns of ``df`` are not read.
    """
    stored = table(pieces(df, id_col, text_col, capacity, with_ids=with_ids), "pieces")
    return pack(stored, "length", capacity, ["doc_id", "piece", "ids_crc32"])
