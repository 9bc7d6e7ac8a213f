"""Fill-in-the-middle: documents cut at two token borders and put together in another order.

A batch of texts is one byte buffer. Every byte of a cut text moves by the shift of its part, so the shifts of a whole batch are a
difference array with an entry where a part begins; its running sum gives every byte its place, and one scatter writes the
outputs. The marks in an output give the same shifts again, so one gather restores the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import SPACE, bodies, keyed, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = 0, 1, 2
NAMES = np.array(["plain", "psm", "spm"])
MARK = len(PREFIX)
SEED = 42
# Of a hundred documents, so many are cut; of a hundred of these, so many begin with the suffix.
CUT_PERCENT, SPM_PERCENT = 50, 80
# Bytes scanned or moved in one go; the arrays in between are some ten times as large.
PIECE = 1 << 20


def pieces(n: int) -> Iterator[tuple[int, int]]:
    for at in range(0, n, PIECE):
        yield at, min(n, at + PIECE)


def token_ends(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The end of every token: of each word, which takes the white space before it, and of white space that ends a text."""
    found, last = [], np.zeros(len(raw) + 1, bool)
    last[offsets[1:]] = True
    for a, b in pieces(len(raw)):
        space = SPACE[raw[a : min(b + 1, len(raw))]]
        here = ~space[: b - a]
        here[: len(space) - 1] &= space[1:]
        found.append(np.flatnonzero(here | last[a + 1 : b + 1]) + (a + 1))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def marked(raw: np.ndarray, mark: bytes) -> np.ndarray:
    """Where ``mark`` begins, across row borders too."""
    found = []
    for a, b in pieces(len(raw)):
        seen = raw[a : b + MARK - 1]
        n = len(seen) - MARK + 1
        if n > 0:
            found.append(np.flatnonzero((seen[:n] == mark[0]) & (seen[1 : n + 1] == mark[1]) & (seen[2 : n + 2] == mark[2])) + a)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def holding(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows contain one of the marks."""
    out = np.zeros(len(offsets) - 1, bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        at = marked(raw, mark)
        row = np.searchsorted(offsets, at, side="right") - 1
        out[row[at + MARK <= offsets[row + 1]]] = True
    return out


def layout(lengths: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of part lengths (prefix, middle, suffix): the size of each output, and the place of each part in it."""
    p, m, s = lengths.T
    cut = form != PLAIN
    size = p + m + s + 3 * MARK * cut
    at = np.zeros_like(lengths)
    psm = np.stack([np.full_like(p, MARK), p + s + 3 * MARK, p + 2 * MARK], 1)
    spm = np.stack([s + 2 * MARK, s + p + 3 * MARK, np.full_like(p, MARK)], 1)
    plain = np.stack([np.zeros_like(p), p, p + m], 1)
    at = np.where((form == PSM)[:, None], psm, np.where((form == SPM)[:, None], spm, plain))
    return size, at


def shifts(lengths: np.ndarray, form: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(difference array as places and steps, output row boundaries): at each place in the texts the shift changes by the step."""
    size, at = layout(lengths, form)
    rows = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=rows[1:])
    begins = starts[:, None] + np.concatenate([np.zeros((len(size), 1), np.int64), np.cumsum(lengths[:, :2], axis=1)], axis=1)
    shift = (rows[:-1, None] + at - begins).reshape(-1)
    filled = lengths.reshape(-1) > 0
    places, shift = begins.reshape(-1)[filled], shift[filled]
    steps = shift.copy()
    steps[1:] -= shift[:-1]
    return places, steps, rows


def moved(n: int, places: np.ndarray, steps: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, places in the output) of the text's bytes, piece by piece."""
    carry = 0
    for a, b in pieces(n):
        change = np.zeros(b - a, np.int64)
        i, j = np.searchsorted(places, [a, b])
        change[places[i:j] - a] = steps[i:j]
        change[0] += carry
        to = np.cumsum(change)
        carry = int(to[-1])
        to += np.arange(a, b)
        yield a, b, to


def scatter(raw: np.ndarray, offsets: np.ndarray, cuts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs, end to end, and their boundaries; ``cuts`` holds both cut places of each row."""
    ends = np.stack([offsets[:-1], cuts[:, 0], cuts[:, 1], offsets[1:]], 1)
    lengths = np.diff(ends, axis=1)
    places, steps, rows = shifts(lengths, form, offsets[:-1])
    out = np.zeros(int(rows[-1]), np.uint8)
    for a, b, to in moved(len(raw), places, steps):
        out[to] = raw[a:b]
    _, at = layout(lengths, form)
    for k, mark in enumerate((PREFIX, MIDDLE, SUFFIX)):
        begin = (rows[:-1] + at[:, k] - MARK)[form != PLAIN]
        out[begin[:, None] + np.arange(MARK)] = np.frombuffer(mark, np.uint8)
    return out, rows


def gather(out: np.ndarray, rows: np.ndarray, form: np.ndarray) -> np.ndarray:
    """The texts of outputs, from their bytes and forms alone."""
    cut = np.flatnonzero(form != PLAIN)
    lengths = np.zeros((len(form), 3), np.int64)
    lengths[:, 0] = np.diff(rows)
    if len(cut):
        whole = []
        for mark in (PREFIX, SUFFIX, MIDDLE):
            at = marked(out, mark)
            row = np.searchsorted(rows, at, side="right") - 1
            ours = (form[row] != PLAIN) & (at + MARK <= rows[row + 1])
            at, row = at[ours], row[ours]
            if len(at) != len(cut) or (row != cut).any():
                raise ValueError(f"an output does not hold {mark.decode()} once")
            whole.append(at)
        p, s, m = whole
        psm = form[cut] == PSM
        lengths[cut, 0] = np.where(psm, s, m) - p - MARK
        lengths[cut, 2] = np.where(psm, m, p) - s - MARK
        lengths[cut, 1] = rows[cut + 1] - m - MARK
    starts = np.zeros(len(form) + 1, np.int64)
    np.cumsum(lengths.sum(axis=1), out=starts[1:])
    places, steps, _ = shifts(lengths, form, starts[:-1])
    text = np.zeros(int(starts[-1]), np.uint8)
    for a, b, to in moved(len(text), places, steps):
        text[a:b] = out[to]
    return text


def characters(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points between each start and end, both ascending; all bytes but continuations count."""
    edges = np.unique(np.concatenate([starts, ends, [0]]))
    sums = np.zeros(len(edges), np.int64)
    for k in range(1, len(edges)):
        sums[k] = sums[k - 1] + sum(int(np.count_nonzero((raw[a : min(edges[k], a + PIECE)] & 0xC0) != 0x80)) for a in range(int(edges[k - 1]), int(edges[k]), PIECE))
    return sums[np.searchsorted(edges, ends)] - sums[np.searchsorted(edges, starts)]


def transformed(raw: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> dict[str, np.ndarray]:
    """Tokens, forms, cuts and outputs of the rows of one buffer; ``draws`` are four 32-bit numbers a row."""
    ends = token_ends(raw, offsets)
    first = np.searchsorted(ends, offsets[:-1], side="right")
    n = np.searchsorted(ends, offsets[1:], side="right") - first
    both = np.sort(draws[:, :2] % (n[:, None] + 1), axis=1)
    held = np.append(ends, 0)
    cuts = np.where(both > 0, held[np.maximum(first[:, None] + both - 1, 0)], offsets[:-1, None])
    form = np.where(draws[:, 3] % 100 < SPM_PERCENT, SPM, PSM)
    form[(n == 0) | (draws[:, 2] % 100 >= CUT_PERCENT) | holding(raw, offsets)] = PLAIN
    cuts[form == PLAIN] = offsets[:-1][form == PLAIN][:, None]
    out, rows = scatter(raw, offsets, cuts, form)
    return {
        "n": n,
        "form": form,
        "prefix": characters(raw, offsets[:-1], cuts[:, 0]),
        "middle": characters(raw, cuts[:, 0], cuts[:, 1]),
        "out": out,
        "rows": rows,
    }


def binary(data: np.ndarray, rows: np.ndarray) -> pa.Array:
    if len(rows) and rows[-1] >= 1 << 31:
        return pa.array([data[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:])], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(rows) - 1, [None, pa.py_buffer(rows.astype(np.int32)), pa.py_buffer(data)])


def rearrange(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, restore: bool = False) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; with ``restore``, also ``restored``, rebuilt from output and form.

    A token is white space followed by a word, or white space that ends the text. The draws are a hash of the id, so rows of one id are cut alike
    where their texts are equal, and a null id counts as empty text. Null and empty texts are plain and empty; so is every text that holds a mark,
    unchanged. Outputs are UTF-8 bytes. Other columns are left out; an empty table gives an empty result. No row moves between tasks.
    """
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("_hash", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    docs = keyed(df, id_col, text_col).withColumn("_hash", hashed).select("doc_id", "body", *draws)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary" + (", restored binary" if restore else "")

    def run(batches):
        for b in slices(batches, PIECE):
            raw, offsets = bodies(pa.Table.from_batches([b]))
            got = transformed(raw, offsets, np.stack([b[f"h{k}"].to_numpy(zero_copy_only=False) for k in range(1, 5)], 1))
            plain = got["form"] == PLAIN
            columns = [
                b["doc_id"],
                pa.array(got["n"], pa.int64()),
                pa.array(NAMES[got["form"]], pa.string()),
                pa.array(got["prefix"], pa.int64(), mask=plain),
                pa.array(got["middle"], pa.int64(), mask=plain),
                binary(got["out"], got["rows"]),
            ]
            if restore:
                columns.append(binary(gather(got["out"], got["rows"], got["form"]), offsets))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] + ["restored"] * restore)

    return docs.mapInArrow(run, schema)


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form", carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry`` columns and ``text``: the texts of outputs of ``rearrange``, from output and form alone. A null output is a null text."""
    held = df.select(df[output_col].cast("binary").alias("_output"), df[form_col].alias("_form"), *[df[c].alias(f"_c{k}") for k, c in enumerate(carry)])
    kinds = [f"`_c{k}` {df.schema[c].dataType.simpleString()}" for k, c in enumerate(carry)]

    def run(batches):
        for b in slices(batches, PIECE, "_output"):
            filled = b["_output"].fill_null(b"")
            out, rows = bodies(pa.table({"body": filled}))
            form = np.array([{"psm": PSM, "spm": SPM}.get(f, PLAIN) for f in b["_form"].to_pylist()])
            text = gather(out, rows, form)
            ends = np.zeros(len(rows), np.int64)
            np.cumsum(np.diff(rows) - 3 * MARK * (form != PLAIN), out=ends[1:])
            made = binary(text, ends)
            columns = [pa.array([t.as_py() if ok else None for t, ok in zip(made, b["_output"].is_valid().to_pylist())], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [b[f"_c{k}"] for k in range(len(carry))], names=["text"] + [f"_c{k}" for k in range(len(carry))])

    made = held.mapInArrow(run, ", ".join(["text binary", *kinds]))
    return made.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)], F.col("text").cast("string").alias("text"))


FIM_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
drawn AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM docs),
cut AS (SELECT doc_id, text, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b, t,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""
