"""Language identification by multilingual mixture inference.

Each language has a distribution of letter trigrams, hashed to a fixed table and counted over all training
documents. A document is a mixture: each of its words comes from one language, with the document's proportions.
Expectation-maximisation estimates the proportions from the words' likelihoods; languages enter in order of
their share as long as the likelihood, less a penalty for each language, grows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import bodies, carries, fold, keyed, slices

BUCKETS = 1 << 16
# The model is a table of BUCKETS values a language, held by the driver and each worker; more languages fail by name.
MAX_LANGUAGES = 256
# Bytes of text in one call; the arrays of letters and words are some forty times as large.
PIECE = 1 << 20
SMOOTHING = 0.1
UNKNOWN = "und"

LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[65:91] = LETTER[128:] = True
FOLDED = np.where(LETTER, np.arange(256), 32).astype(np.uint8)
FOLDED[65:91] += 32


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions of letters, hashed trigram around each, first letter of each word, row of each word)."""
    folded = FOLDED[raw]
    before, after = np.empty_like(folded), np.empty_like(folded)
    before[1:], after[:-1] = folded[:-1], folded[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = 32
    after[offsets[1:][full] - 1] = 32
    at = np.flatnonzero(folded != 32)
    code = (before[at].astype(np.uint32) << 16) | (folded[at].astype(np.uint32) << 8) | after[at]
    heads = np.flatnonzero(before[at] == 32)
    rows = np.searchsorted(offsets, at[heads], side="right") - 1
    return at, (code * np.uint32(0x9E3779B1)) >> np.uint32(16), heads, rows


def learn(df: DataFrame, lang_col: str, id_col: str, text_col: str) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and the log probability of each trigram bucket in each."""
    docs = keyed(df.where(F.col(lang_col).isNotNull()), id_col, text_col, lang_col).select("body", F.col(lang_col).cast("string").alias("lang"))

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for b in slices(batches, PIECE):
            langs = b["lang"].to_pylist()
            names = sorted(set(langs))
            raw, offsets = bodies(pa.Table.from_batches([b]))
            at, gram, _, _ = trigrams(raw, offsets)
            of = np.array([names.index(x) for x in langs])
            sizes = np.diff(np.searchsorted(at, offsets))
            found = np.bincount(np.repeat(of, sizes) * BUCKETS + gram, minlength=len(names) * BUCKETS)
            for k, name in enumerate(names):
                seen[name] = seen.get(name, 0) + found[k * BUCKETS : (k + 1) * BUCKETS]
        for name, counts in seen.items():
            where = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(where), pa.string()), "bucket": where.astype(np.int32), "n": counts[where].astype(np.int64)})

    sums = docs.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(r[0] for r in docs.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang_col}")
    counts = np.zeros((len(langs), BUCKETS))
    rows = sums.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")) if langs else None
    for lang, b, n in rows.toLocalIterator() if rows is not None else ():
        counts[langs.index(lang), b] = n
    return langs, np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)).astype(np.float32)


def proportions(fit: np.ndarray, cuts: np.ndarray, rows: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixture weights of each document after ``steps`` rounds, and the log likelihood of its words.

    ``fit`` has the words' likelihoods, scaled so that each word's best is 1; words of row ``rows[k]`` begin at
    ``cuts[k]``. A language with weight zero keeps it.
    """
    n = np.diff(np.append(cuts, len(fit)))
    weights = start
    for _ in range(steps):
        share = fit * np.repeat(weights, n, axis=0)
        total = share.sum(axis=1)
        share /= np.maximum(total, 1e-300)[:, None]
        weights = np.add.reduceat(share, cuts, axis=0) / n[:, None]
    total = (fit * np.repeat(weights, n, axis=0)).sum(axis=1)
    return weights, np.add.reduceat(np.log(np.maximum(total, 1e-300)), cuts)


def mixtures(raw: np.ndarray, offsets: np.ndarray, model: np.ndarray, penalty: float = 2.0) -> np.ndarray:
    """Proportions [documents, languages] over the chosen languages; a document without letters has zeros."""
    docs, langs = len(offsets) - 1, len(model)
    out = np.zeros((docs, langs))
    at, gram, heads, rows = trigrams(raw, offsets)
    if not len(heads) or not langs:
        return out
    fit = np.stack([np.add.reduceat(m[gram], heads) for m in model], axis=1).astype(np.float64)
    fit = np.exp(fit - fit.max(axis=1, keepdims=True))
    cuts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    who = rows[cuts]
    n = np.diff(np.append(cuts, len(rows)))
    full, _ = proportions(fit, cuts, rows, np.full((len(who), langs), 1 / langs), 8)
    order = np.argsort(-full, axis=1, kind="stable")
    best, gain = np.zeros_like(full), np.full(len(who), -np.inf)
    open_ = np.arange(len(who))
    for k in range(1, langs + 1):
        allowed = np.zeros((len(open_), langs))
        np.put_along_axis(allowed, order[open_, :k], 1 / k, axis=1)
        of = np.concatenate([np.arange(cuts[d], cuts[d] + n[d]) for d in open_]) if k > 1 else slice(None)
        sub = np.cumsum(n[open_]) - n[open_]
        weights, likely = proportions(fit[of], sub, rows, allowed, 6 if k > 1 else 0)
        likely -= penalty * (k - 1) * np.log(n[open_] + 1)
        better = likely > gain[open_]
        kept = open_[better]
        best[kept], gain[kept] = weights[better], likely[better]
        open_ = kept
        if not len(open_):
            break
    out[who] = best
    return out


@carries
def identify(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, penalty: float = 2.0, keep_body: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, shares) of every row, with the columns ``carry`` as they are, and with ``keep_body`` the
    text as UTF-8 bytes, ``body``, so that it need not be carried beside them.

    Learns from rows outside fold 0 (crc32 of the id as text, modulo ``folds``) with a language. ``languages`` and
    ``shares`` list the chosen languages, largest share first; the first is ``lang_pred`` and its share ``score``.
    Null and empty texts, texts without a letter, and all texts where nothing could be learned are ``und`` with score 0.
    Equal shares go to the alphabetically first language. Repeated rows get equal results; a null id counts as
    empty text for the fold.
    """
    langs, model = learn(df.where(fold(id_col, folds) != 0), lang_col, id_col, text_col)
    held = df.withColumn("_held", fold(id_col, folds) == 0)
    docs = keyed(held, id_col, text_col, "_held", *carry)
    kept = ["body"] * keep_body

    def run(batches):
        for b in slices(batches, PIECE // 4):
            raw, offsets = bodies(pa.Table.from_batches([b]))
            shares = mixtures(raw, offsets, model, penalty)
            order = np.argsort(-shares, axis=1, kind="stable")
            chosen = [[k for k in o if s[k] > 0] for o, s in zip(order.tolist(), shares.tolist())]
            for d, c in enumerate(chosen):
                if c and not has_letter(raw[offsets[d] : offsets[d + 1]]):
                    chosen[d] = []
            top = [shares[d, c[0]] if c else 0.0 for d, c in enumerate(chosen)]
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"],
                    b["_held"],
                    pa.array([langs[c[0]] if c else UNKNOWN for c in chosen], pa.string()),
                    pa.array(top, pa.float64()),
                    pa.array([[langs[k] for k in c] for c in chosen], pa.list_(pa.string())),
                    pa.array([shares[d, c].tolist() for d, c in enumerate(chosen)], pa.list_(pa.float64())),
                    *[b[n] for n in (*kept, *carry)],
                ],
                ["doc_id", "held_out", "lang_pred", "score", "languages", "shares", *kept, *carry],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", `{n}` {docs.schema[n].dataType.simpleString()}" for n in (*kept, *carry))
    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>{more}")


def has_letter(raw: np.ndarray) -> bool:
    """Bytes from 128 on may be signs only; then the characters decide."""
    if (LETTER[raw] & (raw < 128)).any():
        return True
    return any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))
