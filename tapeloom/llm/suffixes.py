"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text``, whose last symbol is its only smallest one.

    Suffixes are classed as larger (L) or smaller (S) than the next; the substrings between leftmost-smaller
    (LMS) positions are sorted and named, their order is found by recursion where names repeat, and all other
    suffixes are induced from it in two scans.
    """
    n = len(text)
    if n < 3:
        return np.argsort(text, kind="stable")
    text = text.astype(np.int32)
    differs = np.flatnonzero(text[1:] != text[:-1])
    nearest = np.full(n - 1, n - 1)
    nearest[differs] = differs
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = text[nearest] < text[nearest + 1]
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1

    symbols = 2 * text + smaller
    width = 2 if int(symbols.max()) < 1 << 16 else 4
    raw = symbols.astype(f">u{width}").tobytes()
    ends = np.append(lms[1:] + 1, n)
    parts = [raw[a:b] for a, b in zip((lms * width).tolist(), (ends * width).tolist())]
    named = {part: k for k, part in enumerate(sorted(set(parts)))}
    names = np.fromiter(map(named.__getitem__, parts), np.int32, len(parts))
    del parts
    order = lms[suffix_array(names) if len(named) < len(lms) else np.argsort(names)]

    counts = np.bincount(text)
    ends = np.cumsum(counts)
    first = text[order]
    of_first = np.bincount(first, minlength=len(counts))
    place = ends[first] - of_first[first] + np.arange(len(order)) - (np.cumsum(of_first) - of_first)[first]
    found = np.full(n, n)
    found[place] = order
    found = found.tolist()
    before = np.full(n + 1, -1)
    before[1:n] = np.where(~smaller[:-1], text[:-1], -1)
    links, at = before.tolist(), (ends - counts).tolist()
    for p in found:
        c = links[p]
        if c >= 0:
            found[at[c]] = p - 1
            at[c] += 1
    before[1:n] = np.where(smaller[:-1], text[:-1], -1)
    links, at = before.tolist(), (ends - 1).tolist()
    for p in reversed(found):
        c = links[p]
        if c >= 0:
            found[at[c]] = p - 1
            at[c] -= 1
    return np.array(found)


def common_prefixes(text: np.ndarray, order: np.ndarray, breaks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position of ``text`` (uint16), the prefix its suffix shares with the suffix before and after it in order.

    Prefixes are counted up to ``most`` symbols beyond the nearest of ``breaks`` at or before a position. A suffix whose
    preceding symbol equals that of its predecessor shares one symbol less than the suffix before it in the text:
    only the others, and those at a break, are compared.
    """
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    prior = np.full(n, True)
    prior[1:] = (before[1:] < 1) | (text[:-1] != text[before[1:] - 1])
    prior[breaks] = True
    at = np.flatnonzero(prior & (before >= 0))
    padded = np.concatenate([text.astype("<u2"), np.zeros(most + 8, "<u2")])
    four = np.ndarray((n + most + 4,), "<u8", padded.data, strides=(2,))
    shared = np.zeros(n, np.int64)
    i, j, depth = at, before[at], 0
    while len(i) and depth < most:
        apart = four[i + depth] ^ four[j + depth]
        same = apart == 0
        ended = apart[~same]
        low = ((ended & np.uint64(0xFFFF)) == 0).astype(np.int64)
        low += low * ((ended & np.uint64(0xFFFF0000)) == 0)
        low += (low == 2) * ((ended & np.uint64(0xFFFF00000000)) == 0)
        shared[i[~same]] = depth + low
        i, j, depth = i[same], j[same], depth + 4
    shared[i] = most
    run = np.maximum.accumulate(np.where(prior, np.arange(n), 0))
    shared = np.maximum(shared[run] - (np.arange(n) - run), 0)
    after = np.zeros(n, np.int64)
    after[order[:-1]] = shared[order[1:]]
    return shared, after
