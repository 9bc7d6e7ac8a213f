"""Bigram language model by deleted interpolation.

A token's probability mixes its relative frequency after the token before, its relative frequency at all, and a uniform
share. The weights depend on how often the token before was seen (buckets by powers of two) and are learned by
expectation-maximisation on deleted counts: each training token is predicted by the counts of all other training tokens.
Counts live in shards of the hash space and come to the documents by the block exchange. What the weights need is a
histogram of (bucket, relative frequencies on a logarithmic scale) over all training tokens, of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import common as c

END = np.uint64(0x5851F42D4C957F2D)
# Steps to a power of two of the histogram's frequencies; bucket numbers and bins stay below BINS.
STEPS = 4
BUCKETS = 64
BINS = 64 * STEPS + 2


def tokens(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, hash with the token before, first token of each document); each document ends with END, which
    also stands before its first token."""
    raw, offsets = c.bodies(t)
    raw = c.LOWER[raw]
    starts, ends, rows = c.word_bounds(raw, offsets)
    words = c.word_hashes(raw, starts, ends)
    out = np.full(len(words) + len(offsets) - 1, END)
    out[np.arange(len(words)) + np.repeat(np.arange(len(offsets) - 1), np.diff(rows))] = words
    first = rows[:-1] + np.arange(len(offsets) - 1)
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[first] = END
    return out, c.mixed(before * np.uint64(c.BASES[0]) + out + np.uint64(1)), first


def in_order(t: pa.Table) -> pa.Table:
    return t.sort_by([("doc_id", "ascending"), ("tie", "ascending")])


def count_asks(t: pa.Table, shards: int):
    """The distinct tokens and pairs of a block with their counts in its training documents."""
    one, two, first = tokens(t)
    train = np.repeat(t["train"].to_numpy(), np.diff(np.append(first, len(one))))
    keys, of = np.unique(np.concatenate([one, two]), return_inverse=True)
    counts = np.bincount(of[np.append(train, train)], minlength=len(keys))
    for shard, low, high in c.by_shard(keys, shards):
        yield shard, c.packed(c.deltas(keys[low:high]), counts[low:high])


def sum_counts(asks: list[memoryview]):
    parts = [c.unpacked(blob) for blob in asks]
    keys = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    _, of = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(of, weights=np.concatenate([p[1] for p in parts]).astype(float)).astype(np.int64)
    at = 0
    for k in keys:
        yield c.packed(total[of[at : at + len(k)]])
        at += len(k)


def known(t: pa.Table, replies: dict[int, memoryview]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(count of the token before, of the pair, of the token; first token of each document), by training counts."""
    one, two, first = tokens(t)
    _, of = np.unique(np.concatenate([one, two]), return_inverse=True)
    parts = [c.unpacked(replies[s])[0] for s in sorted(s for s in replies if s >= 0)]
    counts = np.concatenate(parts).astype(np.int64)[of] if parts else np.zeros(0, np.int64)
    single, pair = counts[: len(one)], counts[len(one) :]
    before = np.empty_like(single)
    before[1:] = single[:-1]
    ends = np.append(first[1:], len(one)) - 1
    before[first] = single[ends]
    return before, pair, single, first


def bucket(n: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then by powers of two."""
    return np.frexp(n.astype(float))[1]


def bins(p: np.ndarray) -> np.ndarray:
    """0 for zero, else a position on the logarithmic scale."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(STEPS * np.log2(np.where(p > 0, p, 1))) + 32 * STEPS + 1, 1, BINS - 1), 0).astype(np.int64)


def deleted_counts(t: pa.Table, replies: dict[int, memoryview]) -> pa.Table:
    """(b, p2, p1, n, types): training tokens by bucket and frequencies without the token itself. ``types`` sums each token's
    share of its type, so that it adds up to the number of types."""
    before, pair, single, first = known(t, replies)
    train = np.repeat(t["train"].to_numpy(), np.diff(np.append(first, len(single))))
    before, pair, single = (x[train] for x in (before, pair, single))
    code = (bucket(before - 1) * BINS + bins((pair - 1) / np.maximum(before - 1, 1))) * BINS + bins((single - 1).astype(float))
    cells, of, n = np.unique(code, return_inverse=True, return_counts=True)
    types = np.bincount(of, weights=1 / single, minlength=len(cells)) if len(cells) else np.zeros(0)
    return pa.table({"b": cells // BINS**2, "p2": cells // BINS % BINS, "p1": cells % BINS, "n": n.astype(np.int64), "types": types})


def learned(t: pa.Table, rounds: int = 40) -> np.ndarray:
    """[training tokens, types] and the weights of pair, token and uniform share by bucket, from the whole histogram."""
    n = t["n"].to_numpy().astype(float)
    total, types = n.sum(), np.rint(t["types"].to_numpy().sum())
    level = lambda x: np.where(x > 0, 2.0 ** ((x - 32 * STEPS - 1) / STEPS), 0.0)
    p = np.column_stack([level(t["p2"].to_numpy()), level(t["p1"].to_numpy()) / max(1.0, total - 1), np.full(len(n), 1 / (types + 1))])
    b = t["b"].to_numpy()
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        share = weights[b] * p
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.column_stack([np.bincount(b, weights=share[:, k], minlength=BUCKETS) for k in range(3)]) + 0.5
        weights = sums / sums.sum(axis=1, keepdims=True)
    return np.concatenate([[total, types], weights.ravel()])


def scored(t: pa.Table, replies: dict[int, memoryview]) -> pa.Table:
    before, pair, single, first = known(t, replies)
    model = np.frombuffer(next(r for s, r in replies.items() if s < 0), "<f8")
    total, types, weights = model[0], model[1], model[2:].reshape(BUCKETS, 3)
    w = weights[bucket(before)]
    p = w[:, 0] * pair / np.maximum(before, 1) + w[:, 1] * single / max(1.0, total) + w[:, 2] / (types + 1)
    base = np.log10((single + 1) / (total + types + 1))
    sums = lambda x: np.add.reduceat(x, first)
    return pa.table(
        {
            "doc_id": t["doc_id"],
            "held_out": pa.array(~t["train"].to_numpy()),
            "n_tokens": sums(np.ones(len(single), np.int64)),
            "n_known": sums((single > 0).astype(np.int64)),
            "train_tokens": np.full(len(first), int(total)),
            "base_score": sums(base),
            "score": sums(np.log10(p)),
        }
    )


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows whose crc32 of the id as text, modulo ``folds``, is not ``held``. Null and empty texts are the end
    token alone; a null id counts as empty text for the fold. Repeated rows count and are scored each. Without training
    rows all tokens are unknown and the uniform share is 1. An empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    fold = c.fold(id_col, folds)
    docs = c.keyed(df.withColumn("_train", fold != held), id_col, text_col, "_train").withColumnRenamed("_train", "train").withColumn("tie", F.xxhash64("body"))
    n = c.blocks_for(c.size_of(docs)[1])
    part = c.blocked(docs, n)
    counts = c.answer(c.ask(part, lambda t: count_asks(in_order(t), n)), sum_counts, n)
    cells = c.use(part, counts, lambda t, r: deleted_counts(in_order(t), r), "b long, p2 long, p1 long, n long, types double")
    cells = cells.groupBy("b", "p2", "p1").agg(F.sum("n").alias("n"), F.sum("types").alias("types"))
    cells = cells.unionByName(spark.createDataFrame([(0, 0, 0, 0, 0.0)], cells.schema))
    model = cells.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: pa.table({"reply": pa.array([learned(t).astype("<f8").tobytes()], pa.binary())}), "reply binary")
    notes = model.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(-1).alias("shard"), "reply")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return c.use(part, counts.unionByName(notes), lambda t, r: scored(in_order(t), r) if t.num_rows else empty(t), schema)


def empty(t: pa.Table) -> pa.Table:
    return pa.table(
        {
            "doc_id": t["doc_id"],
            "held_out": pa.array([], pa.bool_()),
            **{k: pa.array([], pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")},
            **{k: pa.array([], pa.float64()) for k in ("base_score", "score")},
        }
    )
