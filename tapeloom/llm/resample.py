"""Importance resampling towards a target text: hashed feature weights, Gumbel top-k, and a distributed radix sort.

Words and word pairs fall into buckets by their crc32. A bucket's gain says how much likelier it is in the target than in the corpus; a
document's weight is the mean gain of its features, read from one array of gains. Documents are ordered by weight plus
noise of their own with a radix sort from the last digit to the first: every pass counts digits by chunk, sums the counts to
global offsets and scatters the rows to their places, so rows only ever meet in chunks of a fixed number.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import LOWER, bodies, keyed, slices, table

BUCKETS = 10_000
SCALE = 1000
SEED = 7
LEAST_WORDS = 20
DRAWN_PERCENT = 25
# Bytes of text in one call.
PIECE = 1 << 20
# Rows of one chunk of the sort, and bits of one digit.
CHUNK_ROWS = 1 << 18
DIGIT_BITS = 12

# A word is a run of ASCII letters, digits and characters beyond ASCII.
WORDS = np.ones(256, bool)
WORDS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

# The polynomial of crc32, low bit first.
POLYNOMIAL = 0xEDB88320
# Words of up to so many bytes are hashed column by column, longer ones alone.
COLUMNS = 64


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


CRC = crc_table()


def zero_tables() -> np.ndarray:
    """[n, k, byte]: the register after n zero bytes, from byte k of a register alone; registers are sums of their bytes."""
    out = np.zeros((COLUMNS + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, COLUMNS + 1):
        out[n] = CRC[out[n - 1] & np.uint32(0xFF)] ^ (out[n - 1] >> np.uint32(8))
    return out


ZEROS = zero_tables()


def after_zeros(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = ZEROS[n, 0, register & np.uint32(0xFF)]
    for k in range(1, 4):
        out ^= ZEROS[n, k, (register >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


def registers(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The crc register after each word, begun at zero; words of more than COLUMNS bytes have none."""
    order = np.argsort(np.where(lengths > COLUMNS, 0, -lengths), kind="stable")
    at, size = starts[order], np.where(lengths > COLUMNS, 0, lengths)[order]
    state = np.zeros(len(at), np.uint32)
    longer = np.searchsorted(-size, -np.arange(1, COLUMNS + 1), side="right")
    for k in range(COLUMNS):
        n = int(longer[k])
        if not n:
            break
        state[:n] = CRC[(state[:n] ^ raw[at[:n] + k]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    return out


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each row, features of each row, bucket of every feature); a row's words come first, then its pairs of neighbours."""
    raw = LOWER[raw]
    starts, ends, first = runs(raw, offsets)
    n = np.diff(first)
    lengths = ends - starts
    bare = registers(raw, starts, lengths)
    short = lengths <= COLUMNS
    size = np.minimum(lengths, COLUMNS)
    full = np.uint32(0xFFFFFFFF)
    state = bare ^ after_zeros(np.full(len(starts), full), size)
    for i in np.flatnonzero(~short):
        state[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes()) ^ 0xFFFFFFFF
    inner = np.ones(max(0, len(starts) - 1), bool)
    inner[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(starts))] - 1] = False
    left = np.flatnonzero(inner)
    space = CRC[(state[left] ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (state[left] >> np.uint32(8))
    pair = after_zeros(space, size[left + 1]) ^ bare[left + 1]
    for i in np.flatnonzero(~short[left + 1]):
        w = left[i] + 1
        pair[i] = zlib.crc32(raw[starts[w] : ends[w]].tobytes(), int(space[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    pairs = np.maximum(n - 1, 0)
    count = n + pairs
    begin = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint16)
    row = np.repeat(np.arange(len(n)), n)
    out[begin[row] + np.arange(len(starts)) - first[:-1][row]] = (state ^ full) % np.uint32(buckets)
    row = row[left]
    out[begin[row] + n[row] + left - first[:-1][row]] = (pair ^ full) % np.uint32(buckets)
    return n, count, out


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each row."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = WORDS[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    before, behind = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    behind[-1], behind[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    return starts, np.flatnonzero(inside & (~behind | border[1:])) + 1, np.searchsorted(starts, offsets)


def bucketed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets): the bucket of every feature of every row as 16-bit integers. Null and empty texts have none."""
    if buckets > 1 << 16:
        raise ValueError("at most 65536 buckets")
    docs = keyed(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches, PIECE):
            raw, offsets = bodies(pa.Table.from_batches([b]))
            words, count, found = features(raw, offsets, buckets)
            ends = np.zeros(len(count) + 1, np.int64)
            np.cumsum(2 * count, out=ends[1:])
            held = found.astype("<u2").view(np.uint8)
            made = pa.array([held[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(words, pa.int64()), pa.array(count, pa.int64()), made], names=["doc_id", "n_words", "n_features", "buckets"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, buckets binary")


def histogram(held: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket. A task sends a row a bucket, and so many rows come to the driver, whatever the table."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for part in slices([b], PIECE, "buckets"):
                raw, _ = bodies(pa.Table.from_batches([part]), "buckets")
                sums += np.bincount(np.frombuffer(raw.tobytes(), "<u2"), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in held.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(SCALE * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def scored(held: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score): the floored mean of gains, and it plus noise by the id."""
    kind = held.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for part in slices([b], PIECE, "buckets"):
                raw, ends = bodies(pa.Table.from_batches([part]), "buckets")
                sums = np.zeros(len(raw) // 2 + 1, np.int64)
                np.cumsum(gain[np.frombuffer(raw.tobytes(), "<u2")], out=sums[1:])
                count = part["n_features"].to_numpy(zero_copy_only=False)
                weight = (sums[ends[1:] // 2] - sums[ends[:-1] // 2]) // np.maximum(count, 1)
                columns = [part["doc_id"], part["n_words"], part["n_features"], pa.array(weight, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    hashed = f"CAST(conv(substr(sha2(concat('{seed}:', coalesce(CAST(doc_id AS STRING), '')), 256), 1, 8), 16, 10) AS DOUBLE)"
    noise = f"CAST(floor(-{SCALE} * ln(-ln(({hashed} + 0.5D) / 4294967296D))) AS LONG)"
    return held.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long").selectExpr("*", f"weight + {noise} AS score")


FIELDS = ("score", "doc_id", "n_features", "weight", "lost")
CHUNKS = "chunk long, n int, rows binary"


def packed_rows(t: pa.Table) -> np.ndarray:
    """Rows as 64-bit integers, a column for each of FIELDS; ``lost`` is 1 where the id is null."""
    out = np.zeros((t.num_rows, len(FIELDS)), "<i8")
    for k, c in enumerate(FIELDS[:-1]):
        out[:, k] = t[c].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    out[:, -1] = t["doc_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    return out


def unpacked_rows(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8").reshape(-1, len(FIELDS))


def digit(rows: np.ndarray, field: str, base: int, shift: int, bits: int) -> np.ndarray:
    """One digit of a key: of the score from the highest down, of ids from the lowest up, of the mark of null ids."""
    x = rows[:, FIELDS.index(field)]
    rise = (np.int64(base) - x if field == "score" else x - np.int64(base)).view(np.uint64)
    return ((rise >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def digits(low: dict[str, int], high: dict[str, int], lost: bool, most_bits: int) -> list[tuple[str, int, int, int]]:
    """(field, base, shift, bits) of every digit of (score descending, null ids last, id ascending), the last digit first."""
    out = []
    for field in ("doc_id", "lost", "score"):
        if field == "lost":
            out += [("lost", 0, 0, 1)] * lost
            continue
        bits = (high[field] - low[field]).bit_length()
        passes = -(-bits // most_bits)
        for k in range(passes):
            each = -(-bits // passes)
            out.append((field, high[field] if field == "score" else low[field], k * each, min(each, bits - k * each)))
    return out


def destinations(chunks: DataFrame, key: tuple[str, int, int, int]) -> DataFrame:
    """(chunk, digits, places): for every chunk, the global place of its first row of each digit.

    Counts are summed in the order of chunks within a digit, and over the digits; there are as many digits as a digit has values.
    """

    def run(batches):
        for b in batches:
            for chunk, blob in zip(b["chunk"].to_pylist(), b["rows"]):
                seen = np.bincount(digit(unpacked_rows(blob.as_buffer()), *key))
                at = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk), pa.int64()), pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["chunk", "digit", "n"])

    counts = table(chunks.select("chunk", "rows").mapInArrow(run, "chunk long, digit int, n long"), "counts")
    base = counts.groupBy("digit").agg(F.sum("n").alias("n")).selectExpr("digit", "sum(n) OVER (ORDER BY digit ROWS UNBOUNDED PRECEDING) - n AS base")
    inside = counts.selectExpr("chunk", "digit", "sum(n) OVER (PARTITION BY digit ORDER BY chunk ROWS UNBOUNDED PRECEDING) - n AS before")
    placed = inside.join(F.broadcast(base), "digit").selectExpr("chunk", "struct(digit, base + before AS place) AS d")
    return placed.groupBy("chunk").agg(F.sort_array(F.collect_list("d")).alias("d")).selectExpr("chunk", "d.digit AS digits", "d.place AS places")


def sort_pass(chunks: DataFrame, key: tuple[str, int, int, int], chunk_rows: int) -> DataFrame:
    """``chunks`` after one stable counting sort by a digit: every row goes to its global place."""

    def scattered(batches):
        for b in batches:
            for blob, values, places in zip(b["rows"], b["digits"], b["places"]):
                rows = unpacked_rows(blob.as_buffer())
                d = digit(rows, *key)
                order = np.argsort(d, kind="stable")
                first = np.searchsorted(d[order], values.values.to_numpy())
                size = np.diff(np.append(first, len(rows)))
                to = np.repeat(places.values.to_numpy() - first, size) + np.arange(len(rows))
                cuts = [0, *(np.flatnonzero(np.diff(to // chunk_rows)) + 1).tolist(), len(rows)]
                held = [pa.array([int(to[i]) // chunk_rows for i in cuts[:-1]], pa.int64())]
                held.append(pa.array([(to[i:j] % chunk_rows).astype("<i4").tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()))
                held.append(pa.array([rows[order[i:j]].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays(held, names=["chunk", "at", "rows"])

    def gathered(t: pa.Table) -> pa.Table:
        at = np.concatenate([np.frombuffer(x.as_buffer(), "<i4") for x in t["at"]])
        out = np.empty((len(at), len(FIELDS)), "<i8")
        out[at] = np.concatenate([unpacked_rows(x.as_buffer()) for x in t["rows"]])
        return pa.table({"chunk": t["chunk"][:1].combine_chunks(), "n": pa.array([len(at)], pa.int32()), "rows": pa.array([out.tobytes()], pa.binary())})

    asked = chunks.join(destinations(chunks, key), "chunk").select("rows", "digits", "places")
    sent = asked.mapInArrow(scattered, "chunk long, at binary, rows binary")
    return table(sent.groupBy("chunk").applyInArrow(gathered, CHUNKS), "sorted")


def ranked(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """``rows`` (doc_id, n_features, weight, score) with ``rank`` from 1: highest score first, ties to the smaller id, null ids last.

    Rows alike in score and id follow each other in the order of n_features and weight.
    """
    held = rows.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("doc_id", "score") for f in (F.min, F.max)]).first()
    low = {c: held[f"min_{c}"] or 0 for c in ("doc_id", "score")}
    high = {c: held[f"max_{c}"] or 0 for c in ("doc_id", "score")}
    n_chunks = max(1, -(-held.n // chunk_rows))

    def begun(t: pa.Table) -> pa.Table:
        out = packed_rows(t)
        out = out[np.lexsort((out[:, 3], out[:, 2]))]
        return pa.table({"chunk": t["chunk"][:1].combine_chunks(), "n": pa.array([len(out)], pa.int32()), "rows": pa.array([out.tobytes()], pa.binary())})

    first = rows.selectExpr("doc_id", "n_features", "weight", "score", f"pmod(xxhash64(doc_id, score, n_features), {n_chunks}L) AS chunk")
    chunks = table(first.groupBy("chunk").applyInArrow(begun, CHUNKS), "chunks")
    for key in digits(low, high, held.ids < held.n, digit_bits):
        chunks = sort_pass(chunks, key, chunk_rows)

    def opened(batches):
        for b in batches:
            for chunk, blob in zip(b["chunk"].to_pylist(), b["rows"]):
                x = unpacked_rows(blob.as_buffer())
                columns = {c: pa.array(x[:, k], pa.int64()) for k, c in enumerate(FIELDS[:-1])}
                columns["doc_id"] = pa.array(x[:, 1], pa.int64(), mask=x[:, -1] > 0)
                columns["rank"] = pa.array(chunk * chunk_rows + 1 + np.arange(len(x)), pa.int64())
                yield pa.RecordBatch.from_arrays([columns[c] for c in ("doc_id", "n_features", "weight", "score", "rank")], names=["doc_id", "n_features", "weight", "score", "rank"])

    return chunks.mapInArrow(opened, "doc_id long, n_features long, weight long, score long, rank long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = DRAWN_PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, chunk_rows: int = CHUNK_ROWS, digit_bits: int = DIGIT_BITS,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ids are integers.

    ``percent`` of the rows with ``least_words`` words or more are drawn and have a rank, the others have none. Null and empty texts have no
    features and weight zero; a null id counts as empty text for its noise and comes last among equal scores; repeated rows are
    drawn one by one. Without target texts all gains come from the corpus alone. Other columns are left out; an empty table gives an empty result.
    """
    held = table(bucketed(docs, id_col, text_col, buckets), "buckets")
    wanted = bucketed(target.select(F.lit(0).alias("item"), F.col(target_text).alias("body")), "item", "body", buckets)
    gain = gains(histogram(held, buckets), histogram(wanted, buckets))
    rows = table(scored(held, gain, seed).withColumn("doc_id", F.col("doc_id").cast("long")), "scores")
    fit = rows.where(F.col("n_words") >= least_words).drop("n_words")
    drawn = fit.count() * percent // 100
    order = ranked(fit, chunk_rows, digit_bits)
    rest = rows.where(F.col("n_words") < least_words).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest)


# The crc32 of each distinct feature is a fold over its bytes, through a table made by eight folds of its own.
RESAMPLE_SQL = r"""
WITH crc AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)),
texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
words AS MATERIALIZED (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
found AS MATERIALIZED (SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM words),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM found)),
hashed AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(1, length(h), 2), lambda k: ('0x' || h[k:k + 1])::BIGINT),
    lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM hexed, crc),
sums AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 't') AS t FROM found JOIN hashed USING (f) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS g FROM sums),
weights AS (SELECT id, count(*) AS n, floor(sum(g) / count(*))::BIGINT AS weight FROM found JOIN hashed USING (f) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY id),
scores AS (SELECT d.id AS doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || d.id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM words d LEFT JOIN weights USING (id) WHERE d.kind = 'd')
SELECT doc_id, n_features, weight, score,
  CASE WHEN words >= 20 AND row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) <= 25 * count(*) FILTER (words >= 20) OVER () // 100
    THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END::BIGINT AS rank
FROM scores"""
