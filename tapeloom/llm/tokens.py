"""Token ids of texts by a public tokenizer, with the ids of words it has seen kept between texts."""

from __future__ import annotations

import re

import public_tokenizers
from tokenizers import Tokenizer, pre_tokenizers

VOCABULARY = "word_bpe_49k.json"

# Texts of these characters need no Unicode normal form, have one-to-one lower case and no special token;
# the tokenizer splits them into the pieces of SPLIT, and encodes each piece by itself. All other texts go
# through the tokenizer whole.
PLAIN = re.compile(r"[^\t\n\r -;=-~À-ÖØ-öø-ÿ]")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
# Pieces kept by a worker; beyond it the store starts anew.
KEPT = 800_000


class Pieces(dict):
    """Ids of the pieces seen so far; a new piece is encoded by the tokenizer's model.

    The model reads bytes as the printable characters that the tokenizer's byte-level step writes for them.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.model = tokenizer.model
        step = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {c: step.pre_tokenize_str(chr(c))[0][0] for c in (*range(33, 127), *range(0xC0, 0x100))}

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece.translate(self.written))])
        self[piece] = ids
        return ids


class Encoder:
    """``encode(text)`` gives the ids as little-endian 32-bit integers, equal to the tokenizer's own."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Pieces(self.tokenizer)

    def encode(self, text: str) -> bytes:
        if PLAIN.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return b"".join([i.to_bytes(4, "little") for i in ids])
        pieces = self.pieces
        if len(pieces) > KEPT:
            pieces.clear()
        return b"".join([pieces[p] for p in SPLIT.findall(text.lower())])


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = VOCABULARY) -> Encoder:
    """The worker's encoder for a vocabulary file of the public set, or for a path."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name if "/" in name else public_tokenizers.path(name))
    return _ENCODERS[name]
