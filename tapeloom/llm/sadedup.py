"""Exact removal of repeated byte strings by suffix arrays of shards.

Anchors route what may repeat: a string of ``length`` bytes contains ``length - GRAM + 1`` grams of GRAM bytes, and
the leftmost of smallest hash among them is its anchor, the same wherever the string occurs. Grams that occur
once in the corpus can't anchor a repeat. Around each other anchor lies a context, the bytes of all strings it
anchors; contexts go to a shard by their anchor's hash, so equal strings meet in one shard. There the distinct
contexts are joined into one text, whose suffix array is induced, and a string repeats if its suffix shares
``length`` bytes with a neighbour, or if its whole context occurs more than once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import common as c
from tapeloom.llm.suffixes import common_prefixes, suffix_array

# Symbols of a text whose suffix array is built at once.
TEXT = 1 << 20


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each anchor, first start it anchors, number of starts); strings stay inside documents."""
    none = np.zeros(0, np.int64)
    parts = [(none.astype(np.uint64), none, none)]
    for at, to in c.row_pieces(offsets):
        low, high = int(offsets[at]), int(offsets[to])
        keys, first, many = _anchors(raw[low:high], offsets[at : to + 1] - low, length, gram)
        parts.append((keys, first + low, many))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    starts = c.inner_starts(offsets, length)
    if not len(starts):
        return none.astype(np.uint64), none, none
    hashes = c.mixed(c.rolled(c.BYTE_TABLES[0][raw], gram, c.BASES[0]))
    low = np.uint64((1 << 32) - 1)  # upper half: hash, the same cut everywhere; lower half: place, so ties go to the left
    best, span, need = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), 1, length - gram + 1
    while 2 * span <= need:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if need > span:
        best = np.minimum(best[: len(best) - (need - span)], best[need - span :])
    chosen = (best[starts] & low).astype(np.int64)
    heads = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    # the smallest of many hashes lie low: scrambled anew, keys spread evenly over shards
    return c.mixed(hashes[chosen[heads]] + np.uint64(1)), starts[heads], np.diff(np.append(heads, len(starts)))


def in_order(t: pa.Table) -> pa.Table:
    return t.sort_by([("doc_id", "ascending"), ("tie", "ascending")])


def asked_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, at most two of each; where each distinct one begins; which of these each key is."""
    distinct, of, counts = np.unique(keys, return_inverse=True, return_counts=True)
    times = np.minimum(counts, 2)
    return np.repeat(distinct, times), np.cumsum(times) - times, of


def anchor_asks(t: pa.Table, length: int, gram: int, shards: int):
    raw, offsets = c.bodies(in_order(t))
    keys, _, _ = asked_keys(anchors(raw, offsets, length, gram)[0])
    for shard, low, high in c.by_shard(keys, shards):
        yield shard, c.packed(c.deltas(keys[low:high]))


def repeated_keys(asks: list[memoryview]):
    """One bit for each key: it occurs more than once in all."""
    parts = [np.cumsum(c.unpacked(blob)[0], dtype=np.uint64) for blob in asks]
    keys, of, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    hit, at = counts[of] > 1, 0
    for p in parts:
        yield np.packbits(hit[at : at + len(p)]).tobytes()
        at += len(p)


def context_asks(t: pa.Table, replies: dict[int, memoryview], length: int, gram: int, shards: int):
    """The distinct contexts of repeated anchors, and a note of where each occurs."""
    raw, offsets = c.bodies(in_order(t))
    keys, first, many = anchors(raw, offsets, length, gram)
    asked, head, which = asked_keys(keys)
    bits = np.zeros(len(asked), bool)
    for shard, low, high in c.by_shard(asked, shards):
        bits[low:high] = np.unpackbits(np.frombuffer(replies[shard], np.uint8), count=high - low).astype(bool)
    order = np.argsort(keys, kind="stable")
    order = order[bits[head[which[order]]]]
    keys, first, many = keys[order], first[order], many[order]
    text = raw.tobytes()
    seen: dict[bytes, int] = {}
    ends = first + many + length - 1
    of = np.array([seen.setdefault(text[a:b], len(seen)) for a, b in zip(first.tolist(), ends.tolist())], np.int64)
    _, at, counts = np.unique(of, return_index=True, return_counts=True)
    bodies, sent = list(seen), []
    for shard, low, high in c.by_shard(keys[at], shards):
        sent.append(high - low)
        head = c.packed(c.deltas(keys[at[low:high]]), many[at[low:high]], np.minimum(counts[low:high], 2) - 1)
        yield shard, np.array([len(head)], "<u4").tobytes() + head + b"".join(bodies[low:high])
    yield -1, c.packed(first, many, of, np.array(sent, np.int64))


def repeated_strings(asks: list[memoryview], length: int):
    """One bit for each start of each context: its string occurs elsewhere too.

    The distinct contexts are ordered by anchor and joined to texts of about TEXT symbols, cut between anchors only. A context
    that is the only one of its anchor has no other to share a string with: how often it occurs decides.
    """
    seen: dict[bytes, int] = {}
    times: list[int] = []
    sizes: list[int] = []
    anchored: list[int] = []
    entries = []
    for blob in asks:
        head = 4 + int.from_bytes(blob[:4], "little")
        keys, many, more = c.unpacked(blob[4:head])
        many = many.astype(np.int64)
        raw = bytes(blob[head:])
        ends = np.cumsum(many + length - 1)
        ids = []
        for a, b, k, m, key in zip((ends - many - length + 1).tolist(), ends.tolist(), many.tolist(), more.tolist(), np.cumsum(keys, dtype=np.uint64).tolist()):
            x = raw[a:b]
            if x in seen:
                times[seen[x]] = 2
            else:
                seen[x] = len(times)
                times.append(1 + m)
                sizes.append(k)
                anchored.append(key)
            ids.append(seen[x])
        entries.append((np.array(ids), many))
    bodies, many = list(seen), np.array(sizes, np.int64)
    del seen
    keys = np.array(anchored, np.uint64)
    order = np.argsort(keys, kind="stable")
    if len(order):
        alone = np.ones(len(order) + 1, bool)
        alone[1:-1] = keys[order[1:]] != keys[order[:-1]]
        order = order[~(alone[1:] & alone[:-1])]
    first = np.cumsum(many) - many
    hit = np.repeat(np.array(times) > 1, many)
    at = 0
    while at < len(order):
        reach = np.cumsum(many[order[at:]] + length)
        to = at + max(1, int(np.searchsorted(reach, TEXT)))
        while to < len(order) and keys[order[to]] == keys[order[to - 1]]:
            to += 1
        mine = order[at:to]
        for k, marks in zip(mine.tolist(), _in_one_text([bodies[k] for k in mine.tolist()], many[mine], length)):
            hit[first[k] : first[k] + many[k]] |= marks
        at = to
    for ids, sizes_ in entries:
        steps = np.arange(int(sizes_.sum())) - np.repeat(np.cumsum(sizes_) - sizes_, sizes_)
        yield np.packbits(hit[np.repeat(first[ids], sizes_) + steps]).tobytes()


def _in_one_text(bodies: list[bytes], many: np.ndarray, length: int) -> list[np.ndarray]:
    """For each body, which of its first ``many`` strings start anywhere else in these bodies."""
    text = np.frombuffer(b"\0".join(bodies) + b"\0\0", np.uint8).astype(np.uint16) + np.uint16(2)
    spans = many + length
    breaks = np.cumsum(spans) - spans
    text[breaks + spans - 1] = 1
    text[-1] = 0
    before, after = common_prefixes(text, suffix_array(text), breaks, int(spans.max()))
    longest = np.maximum(before, after)
    return [longest[b : b + m] >= length for b, m in zip(breaks.tolist(), many.tolist())]


def kept_bytes(t: pa.Table, replies: dict[int, memoryview], length: int, carry: list[str]) -> pa.Table:
    t = in_order(t)
    raw, offsets = c.bodies(t)
    first, many, of, sent = (x.astype(np.int64) for x in c.unpacked(next(r for s, r in replies.items() if s < 0)))
    sizes = np.zeros(int(sent.sum()), np.int64)
    sizes[of] = many
    begin = np.cumsum(sizes) - sizes
    flat, at = [], 0
    for k, shard in zip(sent.tolist(), sorted(s for s in replies if s >= 0)):
        flat.append(np.unpackbits(np.frombuffer(replies[shard], np.uint8), count=int(sizes[at : at + k].sum())))
        at += k
    bits = np.concatenate([np.zeros(0, np.uint8), *flat]).astype(bool)
    steps = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    starts = (np.repeat(first, many) + steps)[bits[np.repeat(begin[of], many) + steps]] if len(of) else first
    gone = c.covered(starts, length, len(raw))
    heads = gone.copy()
    heads[1:] &= ~gone[:-1]
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    heads[inner] = gone[inner]
    total, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(heads))
    kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    out = {n: t[n] for n in ["doc_id", *carry]}
    out |= {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(total[offsets[1:]] - total[offsets[:-1]])}
    out |= {"n_spans": pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), "kept": pa.array(kept, pa.binary())}
    return pa.table(out)


@c.carries
def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, n_bytes, n_removed, n_spans, kept) of every row: ``kept`` has the bytes outside strings of
    ``length`` bytes that start anywhere else too.

    Null and empty texts, and texts shorter than ``length``, lose nothing. Equal rows are copies of each other and lose
    all their strings. An empty table gives an empty result. Columns of ``df`` that are not named are not read.
    """
    gram = max(1, length // 4)
    docs = c.keyed(df, id_col, text_col, *carry).withColumn("tie", F.xxhash64("body"))
    n = c.blocks_for(c.size_of(docs)[1])
    part = c.blocked(docs, n)
    known = c.answer(c.ask(part, lambda t: anchor_asks(t, length, gram, n)), repeated_keys, n)
    contexts = c.ask_again(part, known, lambda t, r: context_asks(t, r, length, gram, n))
    found = c.answer(contexts, lambda q: repeated_strings(q, length), n)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select("doc_id", *carry).schema)
    return c.use(part, found, lambda t, r: kept_bytes(t, r, length, list(carry)), f"{kinds}n_bytes long, n_removed long, n_spans long, kept binary")
