"""Token ids by the public tokenizers: the library encodes each distinct piece once, numpy gathers the ids.

A batch of texts is one run of bytes.  It is cut where both tokenizers always cut, so joining the ids of the pieces
gives the ids of the whole texts; where a cut isn't certain (near apostrophes, in runs of white space, beside
characters other than ASCII and the letters of Latin-1) none is made, so a text that could not be cut at all is
encoded whole.  Arrow's dictionary of the pieces leaves one of each and a bounded cache knows most.  Of the others,
those that are one word or one run of marks go to the tokenizer's model directly, the rest through all of its steps.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker's cache holds before it starts anew (about 200 bytes each), and the longest piece that it keeps.
CACHE_PIECES, CACHE_BYTES = 200_000, 48
#: Bytes and rows of text that are worked on at a time, whole texts.
STEP_BYTES, STEP_ROWS = 4 << 20, 1024
_encoders: dict[tuple[str, int | None], Encoder] = {}
#: Letters and marks of which a piece is one token of both pre-tokenizers, whatever the version of Unicode.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_SIMPLE = re.compile(f" ?(?:[{_LETTERS}]+|[{_MARKS}]+)")

# classes are bits, so that sets of them are masks
_SPACELIKE, _ODD, _LETTER, _DIGIT, _PUNCT, _QUOTE, _SPACE, _BREAK, _BLANK = (0, *(1 << i for i in range(8)))
_WHITE, _SOLID, _PLAIN = (np.uint8(x) for x in (_SPACE | _BREAK | _BLANK, _ODD | _LETTER | _DIGIT | _PUNCT | _QUOTE, _LETTER | _DIGIT | _PUNCT))
_ASCII_CLASS = [_LETTER if chr(x).isalpha() else _DIGIT if chr(x).isdigit() else _PUNCT if 32 < x < 127 else _SPACELIKE for x in range(128)]
#: Class of a byte: a lead byte stands for the characters that it begins; 0x80 to 0xBF continue the byte before.
_CLASS = np.array(_ASCII_CLASS + [_ODD] * 128, np.uint8)
_CLASS[[9, 11, 12, 13]] = _BLANK
_CLASS[[0x0A, 0x20, 0x27]] = _BREAK, _SPACE, _QUOTE
_CLASS[0xC3] = _LETTER
_CLASS[[0xC2, 0xE1, 0xE2, 0xE3]] = _SPACELIKE  # white space outside ASCII begins with one of these


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def classes(raw: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    c = _CLASS[raw]
    if (raw >= 0x80).any():
        more = np.flatnonzero((raw & 0xC0) == 0x80)
        for _ in range(3):  # a character has at most three bytes after its first
            c[more] = c[more - 1]
        # the signs × and ÷ lie among the letters of Latin-1
        sign = np.flatnonzero((raw[1:] == 0x97) | (raw[1:] == 0xB7))
        sign = sign[raw[sign] == 0xC3]
        c[sign] = c[sign + 1] = _ODD
    return c


def cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending places where pieces begin; ``starts`` are the places where texts begin, all of them cuts."""
    c = classes(raw)
    white, solid, plain = (c & _WHITE) != 0, (c & _SOLID) != 0, (c & _PLAIN) != 0
    after = np.append(solid[1:], False)
    after[starts[1:] - 1] = False  # nothing follows the last character of a text
    cut = np.zeros(len(raw), bool)
    # before white space, and before the last blank of a run of it, which goes with the word
    cut[1:] = (solid[:-1] & white[1:]) | (plain[:-1] & plain[1:] & (c[1:] != c[:-1]))
    cut |= (c == _SPACE) & after
    # after a line feed that stands alone
    alone = np.append(True, solid[:-1])
    alone[starts] = True
    cut[1:] |= (c[:-1] == _BREAK) & alone[:-1] & solid[1:]
    cut[starts] = True
    return np.flatnonzero(cut)


def slices(rows: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """``rows`` in slices of at most ``STEP_ROWS`` rows and about ``STEP_BYTES`` of text, a row at least."""
    total = np.cumsum(pc.fill_null(pc.binary_length(rows.column(column)), 0).to_numpy(zero_copy_only=False))
    at, before = 0, 0
    while at < len(rows):
        to = min(max(at + 1, int(np.searchsorted(total, before + STEP_BYTES, "right"))), at + STEP_ROWS, len(rows))
        yield rows.slice(at, to - at)
        at, before = to, int(total[to - 1])


class Encoder:
    """Ids of texts as unsigned 32-bit integers."""

    def __init__(self, path: str, cache_pieces: int | None = None) -> None:
        self.cache_pieces = cache_pieces or CACHE_PIECES
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        # what stands between pieces that are encoded together, and the character that such pieces must not hold
        self.between, self.own = ("\n", "\n") if ids(" \n ") else (" \1 ", "\1")
        self.mark = ids(self.between)
        self.model = self.tokenizer.model
        # the model's own spelling of each character, as normalizer and pre-tokenizer give it
        chars = [c for c in map(chr, range(256)) if _SIMPLE.fullmatch(c)]
        self.spelling = {ord(c): self._spelled(c) for c in chars} | {ord(" "): self._spelled(" a")[:-1]}
        self._clear()

    def _spelled(self, text: str) -> str:
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _store(self, row: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Rows from ``row`` on: pieces of ``lengths`` ids out of ``ids``."""
        end = row + len(lengths)
        while end > len(self.begin):
            self.begin, self.length = np.append(self.begin, np.zeros_like(self.begin)), np.append(self.length, np.zeros_like(self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.begin[row:end] = self.used + np.cumsum(lengths) - lengths
        self.length[row:end] = lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _simple(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are one token of the pre-tokenizer each, from the model alone."""
        ids, counts = array("I"), array("q")
        tokenize, spelling = self.model.tokenize, self.spelling
        for piece in pieces:
            found = tokenize(piece.translate(spelling))
            counts.append(len(found))
            ids.extend([x.id for x in found])
        return np.frombuffer(ids, np.uint32), np.frombuffer(counts, np.int64)

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has: encoded as one text where the mark parts them without doubt."""
        if len(self.mark) == 1:
            (found,) = self.tokenizer.encode_batch_fast([self.between.join(pieces)], add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            is_mark = ids == self.mark[0]
            at = np.flatnonzero(is_mark)
            if len(at) == len(pieces) - 1:
                return ids[~is_mark], np.diff(at, prepend=-1, append=len(ids)) - 1
        return self._each(pieces)

    def _rows(self, pieces: list[bytes]) -> tuple[np.ndarray, int, int]:
        """Row of each of the distinct ``pieces``; rows and ids in use before those that the cache doesn't keep."""
        rows = np.fromiter(map(self.known.get, pieces, [-1] * len(pieces)), np.int64, len(pieces))
        new = np.flatnonzero(rows < 0).tolist()
        kept = [i for i in new if len(pieces[i]) <= CACHE_BYTES]
        text = {i: pieces[i].decode() for i in kept}
        groups: dict = {self._simple: [], self._together: [], self._each: []}
        for i, x in text.items():
            groups[self._simple if _SIMPLE.fullmatch(x) else self._each if self.own in x else self._together].append(i)
        row = len(self.known)
        for encode, group in groups.items():
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                self._store(row, *encode([text[i] for i in part]))
                rows[part] = np.arange(row, row + len(part))
                row += len(part)
            self.known.update(zip([pieces[i] for i in group], rows[group].tolist(), strict=True))
        mark = row, self.used
        rest = [i for i in new if len(pieces[i]) > CACHE_BYTES]
        for at in range(0, len(rest), 64):
            part = rest[at : at + 64]
            self._store(row, *self._each([pieces[i].decode() for i in part]))
            rows[part] = np.arange(row, row + len(part))
            row += len(part)
        return rows, *mark

    def _encode(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids before each text) of non-empty texts in ``raw``."""
        at = cuts(raw, starts)
        offsets = np.append(at, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        rows, _, used = self._rows(pieces.dictionary.to_pylist())
        rows = rows[pieces.indices.to_numpy()]
        n = self.length[rows]
        before = np.cumsum(n) - n
        place = np.repeat((self.begin[rows] - before).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        ids = self.flat[place]
        self.used = used
        if len(self.known) > self.cache_pieces:
            self._clear()
        return ids, before[np.searchsorted(at, starts)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, their number per text); null and empty texts have none."""
        texts = texts.cast(pa.large_binary()) if texts.type != pa.large_binary() else texts
        if texts.null_count:
            texts = texts.fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        data = texts.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        out, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1)
            full = at + np.flatnonzero(np.diff(offsets[at : to + 1]))
            if len(full):
                ids, before = self._encode(whole[offsets[at] : offsets[to]], offsets[full] - offsets[at])
                out.append(ids)
                counts[full] = np.diff(before, append=len(ids))
            at = to
        return np.concatenate(out), counts


def encoder(path: str, cache_pieces: int | None = None) -> Encoder:
    """One encoder for a path, size of cache and worker."""
    key = path, cache_pieces
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
