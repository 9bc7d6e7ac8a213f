"""Plain versions of the corpus operators, for small tables; ``rows`` are (doc_id, text)."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    body = (text or "").encode()
    return WORD.findall(body.lower() if lower else body)


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(rows, end):
    t = tokenizer()
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], np.uint32) for _, x in rows]


def crc(part):
    return zlib.crc32(np.asarray(part, np.uint32).tobytes())


def best_fit_decreasing(lengths, capacity):
    free, used = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            room = min(fits)
            free.remove(room)
        else:
            room, used = capacity, used + 1
        free.append(room - n)
    return used


def components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def simhash(text):
    w = words(text, True)
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i : i + 4]), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def byte_dedup(rows, length=200):
    """doc -> (n_bytes, n_removed, n_spans, sha256) for each row, in order."""
    texts = [(x or "").encode() for _, x in rows]
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def word_dedup(rows, width=20):
    """(n_words, n_removed, kept text) of each row; ``rows`` in the order in which windows count as earlier."""
    seen, out = set(), []
    for _, x in rows:
        w = words(x)
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[k : k + width] = True
            seen.add(key)
        out.append((len(w), int(gone.sum()), b" ".join(a for a, g in zip(w, gone) if not g)))
    return out
