"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared in buckets that any linked pair must share: 64 bits are cut into ``parts`` pieces, and
two fingerprints within the radius agree on ``parts - radius`` pieces at least. In a bucket the fingerprints lie
as bit planes (plane b holds bit b of 64 fingerprints a word); one pass over the planes adds the differing bits
of many pairs at once into carry-save counters, and queries all of whose lanes exceed the radius are abandoned.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import keyed, table
from tapeloom.llm.graph import components, local_labels

# Fingerprints of one bucket that are compared in one Python call; larger buckets are cut into tiles of it.
TILE = 2048
# Fingerprints, once for each of their buckets and tiles, that one Python call holds.
SHARD_ROWS = 1 << 18


def fingerprint(body: bytes, width: int = 4) -> int:
    """Majority bits of XXH64 (seed 42) over the word shingles; no words: 0, fewer than ``width``: the whole sequence."""
    words = body.lower().split()
    n = len(words)
    if not n:
        return 0
    text = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n <= width:
        return h(text, 42)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    hashes = np.fromiter([h(text[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64, n - width + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, carried columns) of every row; null text counts as empty. ``fp`` is the fingerprint as a signed long."""
    docs = keyed(df, id_col, text_col, *carry)

    def run(batches):
        for b in batches:
            got = [fingerprint(x.as_py(), width) for x in b["body"]]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(np.array(got, np.uint64).view(np.int64)), *[b[n] for n in carry]], ["doc_id", "fp", *carry]
            )

    more = "".join(f", `{n}` {docs.schema[n].dataType.simpleString()}" for n in carry)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long{more}")


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes [64, words] of uint64 values, the first plane the highest bit; the last word is padded."""
    width = -(-len(values) // 64)
    bits = np.zeros((width * 64, 8), np.uint8)
    bits[: len(values)] = values.astype(">u8").view(np.uint8).reshape(-1, 8)
    lanes = np.unpackbits(bits, axis=1).T
    return np.ascontiguousarray(np.packbits(lanes, axis=1, bitorder="little")).view(np.uint64)


def within(queries: np.ndarray, planes: np.ndarray, n: int, radius: int, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, lane) at most ``radius`` bits apart; ``planes`` hold ``n`` fingerprints.

    The counters count to 7 in three bit planes, with a sticky overflow: radii up to 7 are exact.
    """
    valid = np.full(planes.shape[1], ~np.uint64(0))
    if n % 64:
        valid[-1] = np.uint64((1 << (n % 64)) - 1)
    alive = np.arange(len(queries))
    shape = (len(queries), planes.shape[1])
    s0, s1, s2, dead = (np.zeros(shape, np.uint64) for _ in range(4))
    fill = np.zeros(len(queries), np.uint64)
    for b in range(0, 64, 2):
        fill = -((queries[alive] >> np.uint64(63 - b)) & np.uint64(1))
        x = planes[b] ^ fill[:, None]
        fill = -((queries[alive] >> np.uint64(62 - b)) & np.uint64(1))
        y = planes[b + 1] ^ fill[:, None]
        xy = x ^ y
        carry = (x & y) | (xy & s0)
        s0 ^= xy
        more = s1 & carry
        s1 ^= carry
        dead |= s2 & more
        s2 ^= more
        if (b + 2) % step == 0:
            over = dead | above(s0, s1, s2, radius)
            left = ((~over) & valid).any(axis=1)
            if not left.any():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if not left.all():
                alive, s0, s1, s2, dead = alive[left], s0[left], s1[left], s2[left], dead[left]
    hits = ~(dead | above(s0, s1, s2, radius)) & valid
    row, word = np.nonzero(hits)
    bits = np.unpackbits(hits[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(bits)
    return alive[row[at]], word[at] * 64 + lane


def above(s0: np.ndarray, s1: np.ndarray, s2: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count exceeds ``radius``."""
    out, equal = np.zeros_like(s0), ~np.zeros_like(s0)
    for plane, bit in ((s2, radius >> 2 & 1), (s1, radius >> 1 & 1), (s0, radius & 1)):
        if bit:
            equal &= plane
        else:
            out |= equal & plane
            equal &= ~plane
    return out


def bucket_labels(values: np.ndarray, radius: int) -> np.ndarray:
    """For each value of a bucket the smallest position it is linked to, directly or through others here."""
    planes, n = planes_of(values), len(values)
    labels = np.arange(n)
    for at in range(0, n, 256):
        i, j = within(values[at : at + 256], planes, n, radius)
        i = i + at
        labels = local_labels(n, i[i < j], j[i < j], labels)
    return labels


def parts_for(n: int, radius: int) -> int:
    """Pieces of a fingerprint, so that a bucket is expected to hold a few dozen of ``n`` fingerprints."""
    parts = radius + 1
    while parts < 2 * radius and n / 2.0 ** (64 * (parts - radius) / parts) > 64:
        parts += 1
    return parts


def links(fps: DataFrame, radius: int = 4, parts: int | None = None) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints ``fps`` (column fp) as all pairs within ``radius`` do.

    Only a spanning set of each bucket's links is returned. A bucket of more than TILE fingerprints is cut into
    tiles, and each pair of tiles is a task of its own.
    """
    if not 0 <= radius <= 7:
        raise ValueError("radius must be from 0 to 7")
    parts = parts or parts_for(fps.count(), radius)
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    masks = [
        sum(((1 << (edges[p + 1] - edges[p])) - 1) << edges[p] for p in kept) for kept in combinations(range(parts), parts - radius)
    ]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("t", "k"))
    tiles = keys.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"))
    rows = keys.join(tiles.where("n > 1"), ["t", "k"])
    rows = rows.withColumn("m", F.expr(f"cast(ceil(n / {TILE}) AS int)")).withColumn("mine", F.expr("cast(pmod(xxhash64(fp), m) AS int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, m - 1)")))
    rows = rows.selectExpr("t", "k", "fp", "least(mine, other) AS i", "greatest(mine, other) AS j")
    copies = tiles.where("n > 1").agg(F.sum(F.expr(f"n * ceil(n / {TILE})"))).first()[0] or 0
    shards = max(24, fps.sparkSession.sparkContext.defaultParallelism * 4, -(-int(copies) // SHARD_ROWS))
    rows = rows.withColumn("shard", F.expr(f"cast(pmod(xxhash64(t, k, i, j), {shards}) AS int)"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("t", "k", "i", "j", "fp")])
        v = t["fp"].to_numpy().view(np.uint64)
        key = [t[c].to_numpy() for c in ("t", "k", "i", "j")]
        change = np.zeros(len(v), bool)
        change[:1] = True
        for c in key:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.append(np.flatnonzero(change), len(v))
        a, b = [], []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if e - s > 1:
                labels = bucket_labels(v[s:e], radius)
                linked = np.flatnonzero(labels != np.arange(e - s))
                a.append(v[s:e][linked])
                b.append(v[s:e][labels[linked]])
        none = np.zeros(0, np.uint64)
        return pa.table({"a": np.concatenate([none, *a]).view(np.int64), "b": np.concatenate([none, *b]).view(np.int64)})

    return rows.groupBy("shard").applyInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_class) of every row of ``df``.

    ``component_id`` is the smallest id reachable through links of fingerprints; ``n_class`` counts the rows of
    the same fingerprint. Null and empty texts have fingerprint zero and are linked like any other; rows with a
    null id take part, and a component of null ids only has a null id. Repeated rows share a class. An empty
    table gives an empty result. Other columns of ``df`` are not read.
    """
    marked = table(with_fingerprints(df, id_col, text_col, width), "simhash")
    classes = table(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_class")), "simhash-classes")
    comp = components(links(classes.select("fp"), radius))
    joined = classes.join(comp, classes["fp"] == comp["node"], "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = joined.join(least, "component").select("fp", "component_id", "n_class")
    return marked.join(of_class, "fp").selectExpr(
        "doc_id", "lower(lpad(hex(fp), 16, '0')) AS fingerprint", "component_id", "n_class"
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """``df`` with one row of each component, that of the smallest id; rows with a null id can't be told apart and stay.

    Rows of one id with different texts are documents of their own: a component's row is the first by id, fingerprint and a hash of
    the text. Columns of ``df`` must not start with an underscore.
    """
    hashed = df.withColumn("_hash", F.xxhash64(text_col))
    marked = table(with_fingerprints(hashed, id_col, text_col, width, ("_hash",)), "simhash")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "fp", "_hash"))).alias("first")
    classes = table(marked.groupBy("fp").agg(first), "simhash-classes")
    comp = components(links(classes.select("fp"), radius))
    joined = classes.join(comp, classes["fp"] == comp["node"], "left").withColumn("component", F.coalesce("component", "fp"))
    chosen = joined.groupBy("component").agg(F.min("first").alias("first")).selectExpr("first.doc_id AS _chosen", "first._hash AS _chosen_hash")
    same = (F.col(id_col) == F.col("_chosen")) & (F.col("_hash") == F.col("_chosen_hash"))
    kept = hashed.join(chosen, same, "left_semi").dropDuplicates([id_col, "_hash"]).drop("_hash")
    return kept.unionByName(df.where(df[id_col].isNull()))
