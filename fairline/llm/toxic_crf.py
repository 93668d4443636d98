"""Toxic spans by a linear-chain conditional random field.

Every word is toxic or not.  A word's features (itself, its beginnings and its
end, all hashed) give it an emission weight; transitions say how likely toxicity
goes on.  With two states the forward and backward recursions need one ratio per
word, and documents of similar length are run side by side.  Marginals above a
half make spans; the largest marginal, the expected number of toxic words and
its share feed a logistic document score.

Labels exist for documents, so words are labelled first: in toxic training
documents those with a feature that toxic documents have significantly more
often.  The fit takes a bounded sample of labelled rows (``SAMPLE`` of each
class, chosen by a hash of the id), class sizes are counted over all rows.

Nulls and texts without words have no spans and the score of a document without
toxic words.  Ids and labels that are null are not trained on; a document with
several label rows is toxic if one says so.  Repeated rows give repeated rows.
Without labels of both classes all scores are the share of toxic labels.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.llm.common import fresh, text_or_empty, texts
from fairline.session import cut_lineage

#: labelled documents of each class that the fit reads, and how long they may be
SAMPLE, SAMPLE_CHARS = {1: 1500, 0: 2500}, 200_000
HASH = 1 << 17
#: words whose emission a worker remembers
CACHE_WORDS = 300_000
#: words of documents that are run side by side
GROUP_WORDS = 1_000_000
STEPS, RATE, DECAY = 50, 0.3, 1e-4
SPAN = "array<struct<start:int,end:int,p:double>>"

_edges = re.compile(r"^[\W_]+|[\W_]+$")
_W, _P, _S = (zlib.crc32(c) for c in (b"w", b"p", b"s"))


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def slots(word: bytes) -> list[int]:
    """Hashed features: the word without marks at its ends, its beginnings and its last letters."""
    crc = zlib.crc32
    if word.isalnum():  # of ASCII letters and digits alone, so bytes are characters
        n = len(word)
        out = [crc(word, _W) % HASH]
        out += [crc(word[:k], _P) % HASH for k in (4, 5, 6, 7) if n > k]
        if n > 5:
            out.append(crc(word[-5:], _S) % HASH)
        return out
    core = _edges.sub("", word.decode("utf-8", "replace"))
    if not core:
        return []
    parts = [(core, _W), *[(core[:k], _P) for k in (4, 5, 6, 7) if len(core) > k], *([(core[-5:], _S)] if len(core) > 5 else [])]
    return [crc(part.encode(), kind) % HASH for part, kind in parts]


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


class Packed:
    """Words of documents ordered by place, and at each place from the longest document to the shortest.

    The documents that still go on at a place are then the first ones, so a
    step of a recursion is one slice and nothing is padded.  ``where`` tells the
    position of each word of the documents laid end to end.
    """

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        n = -lengths[order]
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.active = np.searchsorted(n, -np.arange(-n[0] if len(n) else 0))
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        place = np.arange(self.at[-1]) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.where = self.at[place] + np.repeat(rank, lengths)

    @cached_property
    def before(self) -> np.ndarray:
        """For every word but the first of its document, the position of the word before it."""
        return np.arange(self.at[min(1, len(self.active))], self.at[-1]) - np.repeat(self.active[:-1], self.active[1:])

    def marginals(self, x: np.ndarray, start: float, moves: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Probability of toxicity per packed word, from packed exponential emissions ``x``."""
        (m00, m01), (m10, m11) = np.exp(moves).tolist()
        active, at = self.active.tolist(), self.at.tolist()
        ahead, back = np.empty_like(x), np.ones_like(x)
        if active:
            ahead[: active[0]] = x[: active[0]] * math.exp(start)
        for t in range(1, len(active)):
            c, s, e = active[t], at[t - 1], at[t]
            r = ahead[s : s + c]
            ahead[e : e + c] = x[e : e + c] * (m01 + m11 * r) / (m00 + m10 * r)
        for t in range(len(active) - 2, -1, -1):
            c, s, e = active[t + 1], at[t], at[t + 1]
            r = x[e : e + c] * back[e : e + c]
            back[s : s + c] = (m10 + m11 * r) / (m00 + m01 * r)
        odds = ahead * back
        if pairs is not None and len(active) > 1:
            a, b = ahead[self.before], (x * back)[at[1] :]
            share = 1 / (m00 + m01 * b + a * (m10 + m11 * b))
            pairs += [[m00 * share.sum(), m01 * (b @ share)], [m10 * (a @ share), m11 * ((a * b) @ share)]]
        return odds / (1 + odds)


def in_groups(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``GROUP_WORDS`` words; a longer document is a run of its own."""
    first = total = 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > GROUP_WORDS:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


def marginals(emissions: list[np.ndarray], start: float, moves: np.ndarray, pairs: np.ndarray | None = None) -> list[np.ndarray]:
    """Probability of toxicity for every word of every document, by forward and backward ratios.

    ``moves`` holds the log weights of transitions (from, to).  ``pairs`` takes
    up the expected number of each transition.
    """
    lengths = np.array([len(e) for e in emissions], np.int64)
    out: list[np.ndarray] = []
    for lo, hi in in_groups(lengths):
        packed = Packed(lengths[lo:hi])
        x = np.empty(len(packed.where))
        x[packed.where] = np.exp(np.clip(np.concatenate(emissions[lo:hi]), -30, 30))
        p = packed.marginals(x, start, moves, pairs)[packed.where]
        out += np.split(p, np.cumsum(lengths[lo:hi])[:-1])
    return out


def summary(p: np.ndarray) -> list[float]:
    """What a document's score is made of."""
    n, total = len(p), float(p.sum())
    top = float(p.max()) if n else 0.0
    top = min(max(top, 1e-6), 1 - 1e-6)
    return [1.0, math.log(top / (1 - top)) / 5, math.log1p(total), total / math.sqrt(n + 10.0), math.log1p(n) / 5]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class ToxicCrf:
    """Weights of the field and of the document score."""

    weights: np.ndarray
    bias: float
    start: float
    moves: np.ndarray
    scorer: np.ndarray
    unseen: float = -8.0  # emission of words without a known feature: the mean of words that are not toxic
    known: dict[bytes, float] = field(default_factory=dict, repr=False)
    plain: list[float] = field(default_factory=list, repr=False)  # weights as numbers that single words look up faster

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "plain": []}

    def emissions(self, text: str) -> np.ndarray:
        known, make, row = self.known.get, self._emission, words(text)
        got = [e if (e := known(w)) is not None else make(w) for w in row]
        return np.array(got, np.float64)

    def _emission(self, word: bytes) -> float:
        if not self.plain:
            self.plain = self.weights.tolist()
        w = [self.plain[i] for i in slots(word)]
        e = self.bias + sum(w) if any(w) else self.unseen
        if len(word) < 40:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = e
        return e

    def tag(self, rows: list[str]) -> list[np.ndarray]:
        return marginals([self.emissions(t) for t in rows], self.start, self.moves)

    def score(self, p: np.ndarray) -> float:
        return float(sigmoid(np.dot(summary(p), self.scorer)))

    def spans(self, text: str, p: np.ndarray) -> list[dict]:
        """Character offsets of runs of words that are toxic rather than not."""
        toxic = np.flatnonzero(p > 0.5)
        if not len(toxic):
            return []
        where = [x.span() for x in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        runs = np.split(toxic, np.flatnonzero(np.diff(toxic) > 1) + 1)
        return [{"start": where[r[0]][0], "end": where[r[-1]][1], "p": float(p[r].max())} for r in runs]


def fit(rows: list[str], toxic: list[int], shares: dict[int, float]) -> ToxicCrf:
    """Train on labelled texts; ``shares`` weighs the classes back to their frequency."""
    y = np.array(toxic)
    rate = shares.get(1, 0.0) / max(sum(shares.values()), 1e-9)
    prior = math.log((rate + 1e-6) / (1 - rate + 1e-6))
    empty = ToxicCrf(np.zeros(HASH), -8.0, 0.0, np.zeros((2, 2)), np.array([prior, 0.0, 0.0, 0.0, 0.0]))
    if not (y == 1).any() or not (y == 0).any():
        return empty
    ids: dict[bytes, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in words(t)], np.int32) for t in rows]
    flat, cuts = array("i"), array("q", [0])
    for w in ids:
        flat.extend(slots(w))
        cuts.append(len(flat))
    slot_at, cut = np.frombuffer(flat, np.int32), np.frombuffer(cuts, np.int64)
    word_at = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(cut))

    # documents of each class that have a feature
    seen = np.zeros((2, HASH))
    for d, label in zip(docs, y):
        here = [slot_at[cut[w] : cut[w + 1]] for w in np.unique(d)]
        if here:
            seen[label, np.unique(np.concatenate(here))] += 1
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    odds = np.log((seen[1] + 0.5) / (n1 - seen[1] + 0.5)) - np.log((seen[0] + 0.5) / (n0 - seen[0] + 0.5))
    error = np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5) + 1 / (n1 - seen[1] + 0.5) + 1 / (n0 - seen[0] + 0.5))
    telling = (seen[1] >= 5) & (odds > 1.2) & (odds / error > 4)
    marked = np.bincount(word_at, telling[slot_at], len(ids)) > 0

    labels = [(marked[d] & (t == 1)).astype(float) for d, t in zip(docs, y)]
    weights, moves, start = np.zeros(HASH), np.zeros((2, 2)), np.zeros(1)
    tokens = np.concatenate(docs)
    packed = Packed(np.array([len(d) for d in docs], np.int64))
    at_place = np.empty_like(tokens)
    at_place[packed.where] = tokens
    n_first = packed.active[:1].sum()
    target = np.bincount(tokens, np.concatenate(labels), len(ids))
    share = max(target.sum(), 1.0) / len(tokens)
    bias = np.array([math.log(share / (1 - min(share, 0.99)))])
    truth = np.zeros((2, 2))
    for lab in labels:
        a, b = lab[:-1].astype(int), lab[1:].astype(int)
        np.add.at(truth, (a, b), 1)
    first = sum(lab[0] for lab in labels if len(lab))
    often = np.bincount(slot_at, np.bincount(tokens, minlength=len(ids))[word_at], HASH) + 1.0
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("w", weights), ("m", moves), ("s", start), ("b", bias))}
    for step in range(1, STEPS + 1):
        by_word = bias[0] + np.bincount(word_at, weights[slot_at], len(ids))
        pairs = np.zeros((2, 2))
        p = packed.marginals(np.exp(np.clip(by_word, -30, 30))[at_place], start[0], moves, pairs)
        miss = target - np.bincount(at_place, p, len(ids))
        grads = {
            "w": np.bincount(slot_at, miss[word_at], HASH) / np.sqrt(often) - DECAY * often**0.5 * weights,
            "m": (truth - pairs) / len(tokens) * 100, "s": np.array([first - p[:n_first].sum()]) / len(docs),
            "b": np.array([miss.sum() / len(tokens) * 100]),
        }
        for key, value in (("w", weights), ("m", moves), ("s", start), ("b", bias)):
            g, (m1, m2) = grads[key], state[key]
            m1 += 0.1 * (g - m1)
            m2 += 0.02 * (g * g - m2)
            value += RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.98**step)) + 1e-8)
    by_word = bias[0] + np.bincount(word_at, weights[slot_at], len(ids))
    plain = np.bincount(tokens, minlength=len(ids)) * ~marked
    model = ToxicCrf(weights, float(bias[0]), float(start[0]), moves, empty.scorer, float((by_word * plain).sum() / max(plain.sum(), 1)))

    # document score: weighted logistic regression by Newton's method
    x = np.array([summary(q) for q in marginals([by_word[d] for d in docs], start[0], moves)])
    weight = np.where(y == 1, shares[1] / n1, shares[0] / n0)
    weight /= weight.mean()
    b = empty.scorer.copy()
    for _ in range(30):
        q = sigmoid(x @ b)
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        move = np.linalg.solve(h, x.T @ (weight * (y - q)) - 0.5 * b)
        b += move
        if np.abs(move).max() < 1e-8:
            break
    model.scorer = b
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample: dict[int, int] = SAMPLE) -> ToxicCrf:
    """Fit on labelled documents outside ``fold``, on at most ``sample`` rows of each class.

    The fit runs in one task, so the driver holds nothing but the weights.  Texts
    of more than ``SAMPLE_CHARS`` characters are left to others of their class.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out("doc_id", folds, fold))
    shares = {r[0]: float(r[1]) for r in known.groupBy("toxic").count().collect() if r[0] in (0, 1)}
    readable = docs.filter(F.length(text_or_empty()) <= SAMPLE_CHARS)
    known = cut_lineage(known.join(readable.select("doc_id"), "doc_id", "left_semi"), "labelled")
    found = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for label, n in sample.items():
        # the lowest hashes: four times as many as are needed go to the sort, however large the class
        reach = int(min(1.0, (4 * n + 1000) / max(found.get(label, 0), 1)) * 2**64) - 2**63
        some = known.filter((F.col("toxic") == label) & (F.xxhash64("doc_id") <= F.lit(min(reach, 2**63 - 1))))
        some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = some if picked is None else picked.unionByName(some)
    rows = readable.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    learn = fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: list[str] = []
        toxic: list[int] = []
        for batch in batches:
            read += texts(batch.column(0))
            toxic += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(read, toxic, shares))], pa.binary())], names=["model"])

    one = rows.repartition(1).sortWithinPartitions("doc_id").select("text", "toxic")  # at most sum(sample) rows
    made = one.mapInArrow(run, "model binary").first()
    return pickle.loads(made[0]) if made else fit([], [], shares)


def tagged(docs: DataFrame, model: ToxicCrf) -> DataFrame:
    """doc_id, score and spans (character offsets, highest marginal) of every whole text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows = list(texts(part.column(1)))
                p = model.tag(rows)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([model.score(x) for x in p], pa.float64()),
                    pa.array([model.spans(t, x) for t, x in zip(rows, p)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))),
                ], names=["doc_id", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, spans {SPAN}")


def drop_toxic(docs: DataFrame, model: ToxicCrf, threshold: float = 0.5) -> DataFrame:
    """``docs`` without documents whose score reaches ``threshold``; all columns as they were, no shuffle."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            got: list[float] = []
            for at in range(0, len(part), 2048):
                got += [model.score(p) for p in model.tag([x or "" for x in part.iloc[at : at + 2048]])]
            yield pd.Series(got, dtype="float64")

    name = fresh(docs, "_toxic")
    return docs.withColumn(name, score(F.col("text"))).filter(F.col(name) < threshold).drop(name)
