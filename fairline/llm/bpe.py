"""BPE encoding and decoding with a backtracking encoder.

A text is cut by the pre-tokeniser's pattern.  For each piece an Aho-Corasick
automaton finds the longest token that starts at every byte.  The encoder walks
from the left, takes the longest token that may follow the one before it, and
steps back where nothing fits.  Two tokens may stand side by side when merging
their bytes gives the same two tokens; that is looked up in a table of pairs,
filled as pairs occur.  Every byte position is left at most once, so the time is
linear in the length of the piece.  Decoding gathers from one blob of all token
bytes by an offset table.

Nulls count as empty texts, which have no tokens.  Repeated rows give repeated
rows; empty tables give empty results.  Other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.common import in_pieces, texts

#: fixed value: how the byte-level pre-tokeniser cuts a text
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the same cut for texts below U+0250, in classes that the quicker built-in matcher knows
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
LATIN = f" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: pieces that a worker remembers, and the longest it remembers
CACHE_PIECES, CACHE_CHARS = 400_000, 40
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """Letter of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BacktrackingBpe:
    """Encoder and decoder of one tokenizers file (byte-level BPE, merges in order of token ids)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        vocab = {w: i for w, i in model["vocab"].items() if w not in special}
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes = [b""] * size
        for word, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in word)
        for word, i in special.items():
            self.bytes[i] = word.encode()
        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.all_pieces, self.latin_pieces = regex.compile(PATTERN).findall, re.compile(LATIN).findall
        self.is_latin = re.compile("[\x00-\u024f]*").fullmatch
        self.length = [len(b) for b in self.bytes]
        self.id_of = {self.bytes[i]: i for i in vocab.values()}

        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        last = -1
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            i, pair = vocab[a + b], (vocab[a], vocab[b])
            if i <= max(last, *pair):
                raise ValueError("merges must be in order of token ids")
            self.halves[i] = self.halves.get(i, pair)
            self.merged[pair] = last = i

        self.automaton = ahocorasick.Automaton()
        for word, i in self.id_of.items():
            self.automaton.add_word(word.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = {i: next((self.id_of[w[:n]] for n in range(len(w) - 1, 0, -1) if w[:n] in self.id_of), -1) for w, i in self.id_of.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, bytes]] = {}

        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum(self.length, out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at one end of ``token`` while it is being merged, each with the merge that ends it."""
        out, until = [(token, NEVER)], token
        while token in self.halves:
            until, token = token, self.halves[token][side]
            out.append((token, until))
        return out

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` leaves exactly these two tokens.

        It does unless some pair across the seam is merged before either part
        of it is absorbed on its own side; of equal merges the left one is first.
        """
        if (known := self.pairs.get((a, b))) is not None:
            return known
        right = self._edge(b, 0)
        good = not any(
            (z := self.merged.get((x, y))) is not None and z < x_until and z <= y_until
            for x, x_until in self._edge(a, 1)
            for y, y_until in right
        )
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        self.pairs[a, b] = good
        return good

    def encode_piece(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        if (whole := self.id_of.get(data)) is not None and self._is_stable(whole):
            return [whole]
        n, length, shorter = len(data), self.length, self.shorter
        longest = [-1] * n
        for end, i in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - length[i]] = i  # ends ascend, so the longest comes last
        open_at, out, at = [True] * (n + 1), [], 0
        token = longest[0]
        while at < n:
            end = at + length[token]
            if open_at[end] and (not out or self.may_follow(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_at[at] = False
                token = out.pop()
                at -= length[token]
        return out

    def _is_stable(self, token: int) -> bool:
        """Whether the bytes of ``token`` merge into it (all tokens made by merges of stable halves that may not stay apart)."""
        return token not in self.halves or not self.may_follow(*self.halves[token])

    def _piece(self, piece: str) -> tuple[int, bytes]:
        ids = self.encode_piece(piece.encode())
        got = len(ids), array("i", ids).tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self.known) >= CACHE_PIECES:
                self.known.clear()
            self.known[piece] = got
        return got

    def pieces(self, text: str) -> list[str]:
        return self.latin_pieces(text) if self.is_latin(text) else self.all_pieces(text)

    def _encoded(self, text: str) -> list[tuple[int, bytes]]:
        known, make = self.known.get, self._piece
        if not self.split_special or not any(x in text for x in self.special):
            return [known(p) or make(p) for p in self.pieces(text)]
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append((1, array("i", [self.special[part]]).tobytes()))
            else:
                out += [known(p) or make(p) for p in self.pieces(part)]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([x[1] for x in self._encoded(text)]), np.int32)

    def count(self, text: str) -> int:
        return sum([x[0] for x in self._encoded(text)])

    def decode(self, ids: np.ndarray) -> str:
        """Text of token ids; bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        ends = np.cumsum(lengths)
        if not len(ends):
            return ""
        where = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
        return self.blob[where].tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def loaded(path: str) -> BacktrackingBpe:
    """The tokenizer of a file, built once per Python worker."""
    return BacktrackingBpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> and decoded text of every whole text of ``docs``.  No shuffle."""

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            for part in in_pieces(batch):
                ids = [bpe.encode(t) for t in texts(part.column(1))]
                sizes = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(sizes), flat), pa.array([bpe.decode(x) for x in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of encoded documents."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
