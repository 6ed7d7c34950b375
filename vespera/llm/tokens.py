"""Whole texts to token ids with the tokenizers library, each distinct piece of text encoded once per worker.

The byte-level pre-tokenizer always starts a new token before a space that a visible character follows, and around a
line feed between visible characters. A text whose only white space is single spaces and line feeds can therefore be
cut there and its pieces looked up: Arrow cuts a batch of texts and numbers its different pieces, only these become Python
strings, and the ids are put together again as one array. Any other text, and one that holds a special token, goes to the library whole.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept_by_worker

TOKENIZER = "byte_bpe_50k.json"
#: Pieces in each of the two generations that a worker remembers, under 250 bytes each: 75 MB at most. A full younger
#: generation becomes the older one; pieces met again come back from it, those not met since are encoded anew.
PIECES = 150_000
#: Bytes of text that are cut at once; the arrays over them take several times as much.
CUT_BYTES = 2 << 20
_MARKS = np.isin(np.arange(256), list(b".,;:!?#$%&*|"))
#: What a text that may be cut does not have: a space or line feed at an end or beside another, other white space, a zero.
_UNCUT = "^[ \n]|[ \n]$|[ \n]{2}|[\\x00\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Letters up to here are letters in any version of Unicode that a library may follow.
_LAST_LETTER = "\u024f"


def _is_word(piece: str) -> bool:
    return piece.isalpha() and (piece.isascii() or max(piece) <= _LAST_LETTER)


def _letter_ends(b: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 end a letter: ASCII ones, and two bytes from U+00C0 to U+023F but the two signs among them."""
    lead = np.concatenate([b[:1], b[:-1]])
    two = (b & 0xC0 == 0x80) & (lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((b == 0x97) | (b == 0xB7)))
    return two | (((b | 0x20) >= 0x61) & ((b | 0x20) <= 0x7A))


class _Pieces(dict):
    """Ids of pieces in bytes, worked out when a piece is first asked for."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn, self.old = learn, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.learn(piece)
        if len(self) >= PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class PieceEncoder:
    """``encode(texts)``: ids of each text as little-endian unsigned 32-bit integers in bytes.

    A piece is a word with the space before it, a line feed, or the marks behind a letter: the pre-tokenizer starts anew
    at each of them whatever stands before.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = self._is_byte_level()
        self.known = _Pieces(self._learn)
        self.model = self.tokenizer.model

    def _is_byte_level(self) -> bool:
        # Only this part is written out: the whole specification holds every merge again.
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        if not (
            self.tokenizer.normalizer is None
            and pre.get("type") == "ByteLevel"
            and not pre["add_prefix_space"]
            and pre["use_regex"]
            and not any(t.lstrip or t.rstrip or t.single_word for t in added)
        ):
            return False
        # The character that the pre-tokenizer writes for each byte, as the library itself shows it.
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        shown = {b: split(chr(b))[0][0] for b in range(128)} | {0xC0 + (n >> 6): split(chr(n))[0][0][0] for n in range(0x80, 0x250)}
        shown |= {0x80 + (n & 63): split(chr(n))[0][0][1] for n in range(0x80, 0x250)}
        self.bytes = shown
        self.space = shown[32]
        return all(shown[b] == chr(b) for b in range(128) if chr(b).isalpha())

    def _whole(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _word(self, letters: str, space: bool) -> bytes:
        """Ids of letters, perhaps after a space: one piece for the pre-tokenizer too, so the model can have it at once."""
        shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.model.tokenize(self.space + shown if space else shown)]).tobytes()

    def _learn(self, piece: str) -> bytes:
        letters = piece[1:] if piece[0] == " " else piece
        return self._word(letters, letters is not piece) if _is_word(letters) else self._whole([piece])[0]

    def _by_pieces(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that may be cut. Each different piece of all of them is looked up once."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")
        raw = joined.buffers()[2]
        b = np.frombuffer(raw, "u1", pc.binary_length(joined)[0].as_py())
        # A piece starts at each space, at and behind each line feed, and at a mark behind a letter.
        starts = (b == 32) | (b == 10)
        starts[1:] |= (b[:-1] == 10) | (_MARKS[b[1:]] & _letter_ends(b)[:-1])
        starts[:1] = True
        places = np.append(np.flatnonzero(starts), len(b)).astype("<i4")
        cut = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), raw)
        pieces = cut.dictionary_encode()
        known = list(map(self.known.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False).tolist()))
        ids = pa.array(known, pa.large_binary()).take(pieces.indices)
        _, ends, out = ids.buffers()
        sizes = pc.binary_length(texts).to_numpy().astype("i8") + 1
        first = np.cumsum(sizes) - sizes  # bytes before each text
        at = np.frombuffer(ends, "<i8")[np.searchsorted(places, np.stack([first, first + sizes - 1]))].tolist()
        view = memoryview(out)
        return [bytes(view[i:j]) for i, j in zip(*at, strict=True)]

    def encode(self, texts: Sequence[str | None] | pa.Array) -> list[bytes]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        filled = pc.fill_null(pc.binary_length(column), 0).to_numpy() > 0
        odd = pc.match_substring_regex(column, _UNCUT)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(column, s))
        odd = pc.fill_null(odd, False).to_numpy(zero_copy_only=False) | (not self.plain)
        out = [b""] * len(column)
        for rows, run in ((filled & ~odd, self._by_pieces), (filled & odd, lambda x: self._whole(x.to_pylist()))):
            at = np.flatnonzero(rows)
            if len(at):
                for i, ids in zip(at.tolist(), run(column.take(pa.array(at))), strict=True):
                    out[i] = ids
        return out


def encoder(path: str, special_as_text: bool = False) -> PieceEncoder:
    return kept_by_worker(f"encoder {path} {special_as_text}", lambda: PieceEncoder(path, special_as_text))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
