"""Token ids by a public tokenizer file, with one encoding for each distinct piece of text.

Both kinds of tokenizer cut a text into pieces before merging, and never merge across certain blanks.  A text is therefore
split at such blanks, and each distinct piece is encoded once for a worker and then looked up by its 64-bit hash.  The
concatenation equals the encoding of the whole text.
"""

from __future__ import annotations

import os
import re

import numpy as np

from weftlog.llm.text import SPACE, Slice, hash_spans, spans

#: Distinct pieces that a worker remembers (about 30 bytes each); beyond that it starts afresh.
REMEMBERED = 1_500_000

#: Bytes after a blank that surely begin no further blank: visible ASCII, and lead bytes under which Unicode has no white space.
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:] = True
_VISIBLE[[0xE1, 0xE2, 0xE3]] = False


def word_pieces(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """For tokenizers that drop white space: the words between ASCII blanks."""
    return spans(piece.data, piece.offsets, SPACE)


def blank_led_pieces(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """For byte-level tokenizers, where the last space before a word belongs to it: each piece begins at such a space or at a text's start."""
    data, n = piece.data, len(piece.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.zeros(n, dtype=bool)
    begins[:-1] = (data[:-1] == 0x20) & _VISIBLE[data[1:]]
    last = piece.offsets[1:] - 1
    begins[last[last >= 0]] = False  # what follows a text's last byte is another text
    begins[piece.offsets[:-1][np.diff(piece.offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n)


class Encoder:
    """Encodes slices of texts. One is kept for each file and process (``encoder``)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a text with a control string is encoded whole: the tokenizer takes the string out before it cuts the rest into pieces
        control = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.control = re.compile(b"|".join(re.escape(x) for x in sorted(control, key=len, reverse=True))) if control else None
        drops_blanks = not self._ids(["a  \n b"])[0] != self._ids(["a b"])[0]
        self.pieces = word_pieces if drops_blanks else blank_led_pieces
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids = self._ids(texts)
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(length.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + total] = np.fromiter((x for y in ids for x in y), np.uint32, total)
        at = self.used + np.cumsum(length) - length
        self.used += total
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.length = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.length, where, length)

    def _whole(self, piece: Slice, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces, but those of a text that holds a control string are the text itself."""
        at = np.array([m.start() for m in self.control.finditer(raw)], np.int64)
        texts = np.unique(np.searchsorted(piece.offsets, at, "right") - 1)
        inside = np.isin(np.searchsorted(piece.offsets, starts, "right") - 1, texts)
        starts, ends = np.concatenate((starts[~inside], piece.offsets[texts])), np.concatenate((ends[~inside], piece.offsets[texts + 1]))
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    def encode(self, piece: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the slice one after another (uint32), and the first id of each text."""
        starts, ends = self.pieces(piece)
        raw = piece.data.tobytes()
        if self.control is not None and self.control.search(raw):
            starts, ends = self._whole(piece, raw, starts, ends)
        keys, first, which = np.unique(hash_spans(piece.data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._forget()
        where = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == keys[inside]
        if not known.all():
            self._learn(keys[~known], [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[~known]])
            where = np.searchsorted(self.keys, keys)
        at, length = self.at[where][which], self.length[where][which]
        before = np.concatenate(([0], np.cumsum(length)))
        ids = self.pool[np.repeat(at - before[:-1], length) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, piece.offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer file; Spark's reused workers keep what it has learned."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
