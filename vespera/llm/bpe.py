"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece of text has one encoding, and that encoding has one last token. The tokens that end at a
position are found by an automaton over the vocabulary's strings that follows suffix links. Among them, the last token
of a prefix is the one that can stand behind the last token of the shorter prefix it leaves: the two are compatible if
encoding their joined bytes gives back just these two. The chain of last tokens, read backwards, is the encoding.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by_worker, smaller_batches

#: Words and tokenizer pieces that a worker remembers; with more it starts afresh, which changes no result.
WORDS, PIECES = 800_000, 1_200_000
_MARKS = ".,;:!?#$%&*|"
_CLASSES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the byte-level pattern


def _byte_names() -> dict[str, int]:
    """How the vocabulary file writes bytes: printable Latin-1 as itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """The encoder for one vocabulary file of the byte-level kind."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["normalizer"]:
            raise ValueError("only plain byte-level vocabularies are read")
        byte = _byte_names()
        raw = {name: bytes(byte[c] for c in name) for name in model["vocab"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: raw[name] for name, i in model["vocab"].items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        #: Merge rank of a pair of ids, and the pair that makes an id.
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        vocab = model["vocab"]
        for order, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            made = vocab[left + right]
            self.rank[vocab[left], vocab[right]] = (order, made)
            self.halves.setdefault(made, (vocab[left], vocab[right]))
        self.order = {i: self.rank[pair][0] for i, pair in self.halves.items()}
        self.suffixes = ahocorasick.Automaton()
        for name, i in vocab.items():
            # Single bytes and what merges can make; a listed string that no merge reaches is never produced.
            if i in self.halves or len(raw[name]) == 1:
                self.suffixes.add_word(raw[name].decode("latin-1"), (len(raw[name]), i))
        self.suffixes.make_automaton()
        self.fits: dict[int, bool] = {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(_CLASSES)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """True if the bytes of both together are encoded as just these two tokens.

        The merges that build ``left`` and ``right`` are replayed backwards along their touching edges. The pair fails
        if some two parts that touch could have merged before the later of the merges that hide one of them.
        """
        pair = left << 20 | right
        got = self.fits.get(pair)
        if got is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            got = self.fits[pair] = self._compatible(left, right)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        never = 1 << 60
        hidden_a = hidden_b = never  # the rank at which the part on that side is taken into a larger one
        while True:
            merge = self.rank.get((a, b))
            # Of equal merges the left one comes first, so it is still in time for a part hidden on its right.
            if merge is not None and merge[0] < hidden_a and merge[0] <= hidden_b:
                return False
            made_a, made_b = self.order.get(a, -1), self.order.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            # Undo the later of the two; of the same merge on both sides, the right one was made later.
            if made_b >= made_a:
                hidden_b, b = made_b, self.halves[b][0]
            else:
                hidden_a, a = made_a, self.halves[a][1]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece of text."""
        n = len(data)
        last, size = [0] * (n + 1), [0] * (n + 1)
        known, fits = self.fits.get, self.compatible
        for at, (length, token) in self.suffixes.iter(data.decode("latin-1")):  # at each place, the longest comes first
            end = at + 1
            if size[end]:
                continue
            start = end - length
            if start:
                if not size[start]:
                    continue
                fit = known(last[start] << 20 | token)
                if not (fits(last[start], token) if fit is None else fit):
                    continue
            last[end], size[end] = token, length
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def _encoded(self, pieces: list[str]) -> bytes:
        cores = self.pieces
        out = []
        for p in pieces:
            got = cores.get(p)
            if got is None:
                got = cores[p] = array("I", self.piece(p.encode("utf-8", "replace"))).tobytes()
            out.append(got)
        return b"".join(out)

    def _learn(self, words: set[str]) -> None:
        new = words - self.words.keys()
        if len(self.words) + len(new) > WORDS:
            self.words.clear()
            new = words
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        for w in new:
            core = w.rstrip(_MARKS)
            if core.isalpha():  # letters, then marks: two pieces
                found = [" " + core, w[len(core) :]] if len(core) < len(w) else [" " + w]
            else:
                found = self.pattern.findall(w if w[0] == "\n" else " " + w)
            self.words[w] = self._encoded(found)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Special tokens keep their ids.

        No token crosses from visible text into a space before visible text, or into a line feed between such: a text
        whose white space is of these two kinds, none of it doubled or at an end, is cut there, and each different word
        is looked at once.
        """
        cut: list[list[str] | None] = []
        words: set[str] = set()
        for t in texts:
            if not t:
                cut.append([])
            elif t.split() == t.replace("\n", " ").split(" ") and not any(s in t for s in self.special):
                parts = t.replace("\n", " \n").split(" ")
                parts[0] = "\n" + parts[0]
                words.update(parts)
                cut.append(parts)
            else:
                cut.append(None)
        self._learn(words)
        get = self.words.__getitem__
        return [
            self._any(t) if c is None else b"".join(map(get, c))[4 if c else 0 :]  # 4: the line feed put before it
            for t, c in zip(texts, cut, strict=True)
        ]

    def _any(self, text: str) -> bytes:
        out = []
        for stretch in self.split.split(text) if self.split else [text]:
            if stretch in self.special:
                out.append(self.special[stretch].to_bytes(4, "little"))
            else:
                out.append(self._encoded(self.pattern.findall(stretch)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        get = self.bytes_of.__getitem__
        return b"".join(map(get, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row; other columns unread.

    A null text is empty: no ids. Null or repeated ids pass through. Texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_by_worker(f"bpe {path}", lambda: ByteBpe(path))
        for batch in smaller_batches(batches):
            ids = bpe.encode(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) to (doc_id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_by_worker(f"bpe {path}", lambda: ByteBpe(path))
        for batch in smaller_batches(batches):
            ids = [memoryview(x).cast("I").tolist() for x in bpe.encode(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, ids array<int>")
