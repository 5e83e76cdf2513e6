"""Encoding of whole texts by a word-level tokenizer file, each distinct piece once.

The tokenizer drops white space before it looks for words, so the ids of a text are the ids
of its white-space-delimited pieces, one after the other. Each worker keeps a bounded table
of pieces it has met; the library encodes the others. Texts with rare white space or control
characters are encoded by the library as a whole.

A piece of letters and then ASCII punctuation is a word and a run of signs, as the tokenizer parts
them; both are met again far more often than the piece, so each is kept by itself. Pieces of
ASCII letters are parted and lower-cased by Arrow, the new ones among the others together.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import only, slices

#: White space and controls on which splitting by ASCII white space and the tokenizer may differ.
RARE_SPACE = "[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -     　]"
_ENDS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which parts letters
_PLAIN = "^[A-Za-z]+[^A-Za-z0-9'[:cntrl:][:space:]]*$"  # to be asked of ASCII pieces
SLICE_BYTES = 4 << 20


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a file."""
    return only(("words", path), lambda: WordEncoder(path))


def _strings(pieces: pa.Array) -> list[str]:
    """Pieces without white space as a list; far quicker than one by one."""
    if not len(pieces):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), pa.scalar("\n", pa.large_string()))[0].as_py().split("\n")


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable letter; this is that public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    def __init__(self, path: str, known_pieces: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}  # lower-cased, of letters alone
        self.signs: dict[str, bytes] = {"": b""}
        self.limit = known_pieces

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, words: pa.Array) -> list[bytes]:
        """The ids of lower-case words of ASCII letters."""
        asked = _strings(words)
        rows = list(map(self.words.get, asked))
        new = [k for k, row in enumerate(rows) if row is None]
        if len(self.words) + len(new) > self.limit:
            self.words.clear()
        tokenize, held = self.model.tokenize, self.words
        for k in new:
            rows[k] = held[asked[k]] = array("I", [t.id for t in tokenize(asked[k])]).tobytes()
        return rows

    def _parted(self, pieces: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Rows of ids, and for each piece the numbers of the two rows that make it."""
        plain = pc.and_(pc.string_is_ascii(pieces), pc.match_substring_regex(pieces, _PLAIN))
        kept = pc.ascii_lower(pieces.filter(plain))
        words = pc.ascii_rtrim(kept, characters=_ENDS)
        runs = pc.replace_substring_regex(kept, "^[a-z]+", "")
        words, runs = words.dictionary_encode(), runs.dictionary_encode()
        others = self.pieces(_strings(pieces.filter(pc.invert(plain))))
        signs = [self.whole(x) if x else b"" for x in runs.dictionary.to_pylist()]
        rows = [b"", *others, *self._plain(words.dictionary), *signs]
        mask = plain.to_numpy(zero_copy_only=False)
        both = np.zeros((len(pieces), 2), np.int64)
        both[~mask, 0] = 1 + np.arange(len(others))
        both[mask, 0] = 1 + len(others) + words.indices.to_numpy(zero_copy_only=False)
        both[mask, 1] = 1 + len(others) + len(words.dictionary) + runs.indices.to_numpy(zero_copy_only=False)
        return rows, both

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, all without white space."""
        rows = list(map(self.known.get, pieces))
        new = [k for k, row in enumerate(rows) if row is None]
        if not new:
            return rows
        asked = [pieces[k] for k in new]
        for held in (self.known, self.words):
            if len(held) + len(new) > self.limit:
                held.clear()
        if len(self.signs) > 10_000:
            self.signs = {"": b""}
        joined = "\n".join(asked)
        sigma = "Σ" in joined  # its lower case depends on its place
        lowered = (joined if joined.isascii() else unicodedata.normalize("NFC", joined)).lower().split("\n")
        words, signs = self.words, self.signs
        for k, piece, low in zip(new, asked, lowered):
            word = low if low.isalpha() else low.rstrip(_ENDS)
            if not word.isalpha() or sigma and "Σ" in piece:
                row = self.whole(piece) if piece else b""
            else:
                row = words.get(word)
                if row is None:
                    row = words[word] = self._word(word)
                if len(word) < len(low):
                    run = low[len(word) :]
                    if run not in signs:
                        signs[run] = self.whole(run)
                    row += signs[run]
            rows[k] = row
        if len(new) <= self.limit:
            self.known.update(zip(asked, map(rows.__getitem__, new)))
        return rows

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and each text's number of ids."""
        parts = [self._slice(part, end_id) for _, part in slices(texts, SLICE_BYTES)]
        if not parts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _slice(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        rare = pc.match_substring_regex(texts, RARE_SPACE).to_numpy(zero_copy_only=False)
        own = {}
        if rare.any():
            own = {int(k): self.whole(texts[int(k)].as_py()) for k in np.flatnonzero(rare)}
            texts = pc.if_else(pa.array(rare), "", texts)
        pieces = pc.ascii_split_whitespace(texts)
        flat = pieces.flatten().dictionary_encode()
        rows, both = self._parted(flat.dictionary)
        codes = both[flat.indices.to_numpy(zero_copy_only=False)].ravel() if len(flat) else np.empty(0, np.int64)
        for k in sorted(own):
            rows.append(own[k])
        # a text encoded as a whole counts as one more piece, at its place
        ends = 2 * (np.asarray(pieces.offsets) - pieces.offsets[0].as_py())
        whole_at = ends[1:][sorted(own)] if own else np.empty(0, np.int64)
        if own:
            codes = np.insert(codes, whole_at, len(rows) - len(own) + np.arange(len(own)))
            ends = ends + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(texts)), sorted(own)))])
        if end_id is not None:
            rows.append(np.array([end_id], "<u4").tobytes())
            codes = np.insert(codes, ends[1:], len(rows) - 1)
            ends = ends + np.arange(len(ends))
        widths = np.fromiter((len(r) // 4 for r in rows), np.int64, len(rows))
        pool = np.frombuffer(b"".join(rows), "<u4")
        starts = np.concatenate([[0], np.cumsum(widths)])[:-1] if len(rows) else widths
        n = widths[codes] if len(codes) else np.empty(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(n)])
        if not len(codes):
            return pool[:0], upto[ends[1:]] - upto[ends[:-1]]
        kind = np.int32 if max(upto[-1], len(pool)) < 2**31 else np.int64  # half the memory to pass through
        at = np.repeat((starts[codes] - upto[:-1]).astype(kind), n)
        at += np.arange(upto[-1], dtype=kind)
        return pool[at], upto[ends[1:]] - upto[ends[:-1]]
