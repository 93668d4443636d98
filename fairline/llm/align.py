"""Alignment of two tokenizers over the same texts.

Both encode a blank and the text, so that their tokens cover the same bytes.  A
task works through blocks of documents.  Within a batch, ``merge_asof`` keyed by
document finds for the start of every token the token of the other side that
covers it.  Two tokens overlap when one of them covers the other's start, so the
two directions together are all links; offsets where both sides start a token
(and end the one before) cut the text into groups.

How often each pair of ids is linked is counted over the corpus: a block lists its
distinct pairs once, with counts, and its documents point into that list by small
integers.  Lists are added up by pair, compared with the highest count of their
second id, joined back, and meet the documents of their block again.  No task
holds more than a block, and no table of all pairs is held anywhere.

Texts that are null, empty, or whose tokens do not give their bytes back on both
sides have no tokens: zeros and the empty string.  Null ids and repeated rows stay
rows of their own; ties for the highest count all count; empty tables give empty
results; other columns are not read.  A text longer than a block is a block.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.bpe import PATTERN, byte_letters
from fairline.llm.common import OUT_ROWS
from fairline.session import cut_lineage

#: characters that are encoded and aligned together, and characters that share a list of pairs
BATCH_CHARS, BLOCK_CHARS = 1 << 19, 1 << 23
#: pair code: first id times this, plus second id
RADIX = 1 << 32
#: texts of these characters, without longer runs, are cut alike by both encoders of the first vocabulary
LATIN = re.compile("[\x00-ɏ]*").fullmatch
LONG_RUN = re.compile(r"(?:^|\s)\S{1000}|(?:^|\S)\s{1000}").search


@dataclass
class Aligned:
    """Tokens of a batch of texts, one after the other, with their groups and links."""

    n_a: np.ndarray  # tokens per text
    n_b: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray
    ends: np.ndarray  # offset behind each group's last byte, from the text's blank on
    n_groups: np.ndarray
    pairs: np.ndarray  # code of each link, in the order of texts
    n_links: np.ndarray
    groups: list[str]  # a1,a2|b1;a3|b2,b3


class Aligner:
    """Both vocabularies and the aligning of batches."""

    def __init__(self, file_a: str, file_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(file_a)
        self.exact.encode_special_tokens = True
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(file_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = byte_letters(), {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.quick = tiktoken.Encoding("quick", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 2)
        for word, i in ranks.items():
            self.bytes_a[i] = word
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=file_b)
        n = self.pieces.get_piece_size()
        self.bytes_b = [
            bytes([int(self.pieces.id_to_piece(i)[3:5], 16)]) if self.pieces.is_byte(i) else self.pieces.id_to_piece(i).replace("▁", " ").encode()
            for i in range(n)
        ]
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.size = max(len(self.bytes_a), n)
        self.written = [f"{i}{mark}" for mark in ",|;" for i in range(self.size)]

    def ids_a(self, text: str) -> np.ndarray:
        """Ids of the first vocabulary; strings of special tokens are plain text."""
        if LATIN(text) and not LONG_RUN(text):
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.int64)

    def _encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a, b, none = [], [], np.empty(0, np.int64)
        for text, second in zip(texts, self.pieces.encode(texts, num_threads=1) if texts else []):
            first, spaced = self.ids_a(" " + text) if text else none, (" " + text).encode()
            good = text and b"".join(map(self.bytes_a.__getitem__, first.tolist())) == spaced == b"".join(map(self.bytes_b.__getitem__, second))
            a.append(first if good else none)
            b.append(np.array(second, np.int64) if good else none)
        return a, b

    def align(self, texts: list[str]) -> Aligned:
        a, b = self._encoded(texts)
        n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (a, b))
        zeros = np.zeros(len(texts), np.int64)
        if not n_a.sum():
            none = np.empty(0, np.int64)
            return Aligned(n_a, n_b, none, none, none, zeros, none, zeros, [""] * len(texts))
        ids_a, ids_b = np.concatenate(a), np.concatenate(b)
        doc_a, doc_b = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
        # offsets run on through the batch; each text has the same bytes on both sides
        size_a, size_b = self.length_a[ids_a], self.length_b[ids_b]
        at_a, at_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        left = pd.DataFrame({"at": at_a, "doc": doc_a, "token": np.arange(len(at_a))})
        right = pd.DataFrame({"at": at_b, "doc": doc_b, "token": np.arange(len(at_b))})
        over_a = pd.merge_asof(left[["at", "doc"]], right, on="at", by="doc")["token"].to_numpy()
        over_b = pd.merge_asof(right[["at", "doc"]], left, on="at", by="doc")["token"].to_numpy()

        opens_a, opens_b = at_b[over_a] == at_a, at_a[over_b] == at_b
        inner = ~opens_b  # equal starts are links of the other direction already
        pairs = np.concatenate([ids_a * RADIX + ids_b[over_a], (ids_a[over_b] * RADIX + ids_b)[inner]])
        docs = np.concatenate([doc_a, doc_b[inner]])
        n_groups = np.bincount(doc_a[opens_a], minlength=len(texts))
        base = np.cumsum(np.bincount(doc_a, size_a, len(texts))).astype(np.int64)
        ends = np.append(at_a[opens_a][1:], base[-1])
        ends -= np.repeat(np.concatenate([[0], base[:-1]]), n_groups)
        return Aligned(
            n_a, n_b, ids_a, ids_b, ends, n_groups, pairs[np.argsort(docs, kind="stable")], np.bincount(docs, minlength=len(texts)),
            self._groups(ids_a, ids_b, opens_a, opens_b, np.cumsum(n_a + n_b)),
        )

    def _groups(self, ids_a, ids_b, opens_a, opens_b, until) -> list[str]:
        """Both sides' ids of every group, written out per text."""
        group_a, group_b = np.cumsum(opens_a) - 1, np.cumsum(opens_b) - 1
        per_a, per_b = np.bincount(group_a), np.bincount(group_b)
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + (np.cumsum(per_b) - per_b)[group_a]] = ids_a + np.append(opens_a[1:], True) * self.size
        order[np.arange(len(ids_b)) + np.cumsum(per_a)[group_b]] = ids_b + np.append(opens_b[1:], True) * 2 * self.size
        words, start, out = list(map(self.written.__getitem__, order.tolist())), 0, []
        for end in until.tolist():
            out.append("".join(words[start:end])[:-1])
            start = end
        return out


@functools.lru_cache(maxsize=2)
def loaded(file_a: str, file_b: str) -> Aligner:
    """Both tokenizers, built once per Python worker."""
    return Aligner(file_a, file_b)


def in_batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of the first two columns in batches bounded by characters and rows."""
    for batch in rows:
        start, size, held = 0, 0, []
        for k in range(batch.num_rows):
            text = batch.column(1)[k].as_py() or ""
            if held and (size + len(text) > BATCH_CHARS or len(held) == OUT_ROWS):
                yield batch.column(0).slice(start, len(held)), held
                start, size, held = k, 0, []
            held.append(text)
            size += len(text)
        if held:
            yield batch.column(0).slice(start, len(held)), held


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def alignments(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """doc_id, ids_a, ids_b, group_ends (bytes from the leading blank on) and groups (ids written out) of every text.  No shuffle."""

    def run(batches):
        aligner = loaded(file_a, file_b)
        for ids, texts in in_batches(batches):
            x = aligner.align(texts)
            yield pa.RecordBatch.from_arrays(
                [ids, _lists(x.ids_a, x.n_a, pa.int32()), _lists(x.ids_b, x.n_b, pa.int32()), _lists(x.ends, x.n_groups, pa.int64()), pa.array(x.groups, pa.string())],
                names=["doc_id", "ids_a", "ids_b", "group_ends", "groups"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids_a array<int>, ids_b array<int>, group_ends array<bigint>, groups string")


def pack(values: np.ndarray) -> bytes:
    """Small integers as planes of bytes, lowest first; there are as many planes as the largest needs."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    width = 4 - next((k for k in range(4) if planes[3 - k].any()), 3) if len(values) else 0
    return planes[:width].tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, n).astype(np.int64)
    return (planes << (8 * np.arange(len(planes)))[:, None]).sum(axis=0)


def _blocks(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """A row per text, whose ``links`` point into the list of its block, and a row per block with that list."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, is_text boolean, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "links binary, pairs array<bigint>, often array<bigint>"
    )
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        aligner, at = loaded(file_a, file_b), TaskContext.get().partitionId() << 32
        places: dict[int, int] = {}
        often, size = np.zeros(0, np.int64), 0
        none = lambda kind: pa.nulls(1, kind)

        def listed(kind):
            return pa.RecordBatch.from_arrays(
                [none(kind), pa.array([False]), pa.array([at]), *[none(pa.int64())] * 4, none(pa.string()), none(pa.binary()),
                 pa.array([list(places)], pa.list_(pa.int64())), pa.array([often.tolist()], pa.list_(pa.int64()))], names=names)

        for ids, texts in in_batches(batches):
            chars = sum(map(len, texts))
            if size and size + chars > BLOCK_CHARS:
                yield listed(ids.type)
                places, often, size, at = {}, np.zeros(0, np.int64), 0, at + 1
            size += max(chars, 1)
            x = aligner.align(texts)
            local, distinct = pd.factorize(x.pairs)
            place = np.array([places.setdefault(p, len(places)) for p in distinct.tolist()], np.int64)
            often = np.concatenate([often, np.zeros(len(places) - len(often), np.int64)])
            np.add.at(often, place, np.bincount(local, minlength=len(place)))
            links = np.split(place[local] if len(place) else local, np.cumsum(x.n_links)[:-1])
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([True] * n), pa.array(np.full(n, at)), *[pa.array(c, pa.int64()) for c in (x.n_a, x.n_b, x.n_groups, x.n_links)],
                 pa.array([g and hashlib.sha256(g.encode()).hexdigest() for g in x.groups], pa.string()), pa.array(list(map(pack, links)), pa.binary()),
                 *[pa.nulls(n, pa.list_(pa.int64()))] * 2], names=names)
        if size:
            yield listed(ids.type)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(listed: DataFrame) -> DataFrame:
    """pair, count and best (no pair with the same second id has more) from blocks' lists (pair, often)."""
    counts = cut_lineage(listed.groupBy("pair").agg(F.sum("often").alias("count")), "pair-counts")
    second = (F.col("pair") % RADIX).alias("second")
    highest = counts.groupBy(second).agg(F.max("count").alias("highest"))
    return counts.withColumn("second", second).join(highest, "second").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def summaries(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """Per text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``n_best`` counts links whose pair is linked corpus-wide as often as any pair
    with that second id; ``count_sum`` adds the corpus-wide counts of all links.
    """
    rows = cut_lineage(_blocks(docs, file_a, file_b), "aligned")
    listed = rows.filter("not is_text").select("block", F.posexplode(F.arrays_zip("pairs", "often")).alias("place", "x"))
    listed = listed.select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.often").alias("often"))
    known = listed.select("block", "place", "pair").join(pair_counts(listed), "pair").select(F.col("block").alias("of"), "place", "count", "best")
    kept = ["n_a", "n_b", "n_groups", "n_links"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def add_up(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        place = pairs.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for data, n in zip(texts.column("links").to_pylist(), texts.column("n_links").to_pylist()):
            at = unpack(data, n) if n else np.empty(0, np.int64)
            n_best.append(int(best[at].sum()))
            count_sum.append(int(count[at].sum()))
        return pa.table([texts.column(c) for c in ("doc_id", *kept)] + [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), texts.column("groups_sha256")],
                        names=["doc_id", *kept, "n_best", "count_sum", "groups_sha256"])

    texts = rows.filter("is_text").select("doc_id", "block", *kept, "links", "groups_sha256")
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in (*kept, "n_best", "count_sum")) + ", groups_sha256 string"
    return texts.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(add_up, schema)
