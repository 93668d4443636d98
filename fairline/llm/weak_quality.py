"""Document quality from weak labels.

Heuristic labellers vote good, low or nothing on every document.  How reliable
each is follows from their agreement: expectation-maximisation over the counts of
vote patterns, which all documents enter (at most 3^m patterns, however many
documents).  The posterior of a pattern labels its documents.  A linear model
over hashed words and word shapes is then fitted to posteriors, on a bounded
sample of rows (``SAMPLE``, even over all rows by a hash, not stratified: frequent
patterns and copies weigh as much as they occur, rare patterns have few rows or
none), and scores every whole text; the final score joins both.

Nulls count as empty texts, on which only the length labeller votes.  Repeated
rows give repeated rows and count each in the statistics.  Empty tables give no
rows.  Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.common import in_pieces, text_or_empty, texts
from fairline.llm.toxic_crf import sigmoid

#: documents that the linear model is fitted on, and how long they may be
SAMPLE, SAMPLE_CHARS = 6000, 200_000
HASH, CACHE_WORDS = 1 << 16, 300_000
STEPS, RATE, DECAY = 80, 0.2, 1e-3
LOW, GOOD, NONE = 0, 1, 2


def measures(text: str) -> dict[str, float]:
    """Counts that the labellers look at, as shares of words, letters or lines."""
    data = text.encode()
    words, lines = data.split(), [x for x in text.split("\n") if x.strip()]
    n, letters = max(len(words), 1), max(len(re.findall(rb"[A-Za-z]", data)), 1)
    return {
        "words": len(words),
        "marked": len(re.findall(rb"([^\w\s\x80-\xff])\1(?=\s|$)", data)) / n,
        "alone": len(re.findall(rb"(?<!\S)[^\w\s\x80-\xff]+(?!\S)", data)) / n,
        "upper": len(re.findall(rb"[A-Z]", data)) / letters,
        "symbols": len(re.findall(rb"[#$%&*+<=>@^_`{|}~\\/\[\]]", data)) / n,
        "stops": len(re.findall(rb"[.!?](?=\s|$)", data)) / n,
        "ended": sum(x.rstrip().endswith((".", "!", "?", '"')) for x in lines) / max(len(lines), 1),
        "lines_again": 1 - len(set(lines)) / max(len(lines), 1),
        "words_again": 1 - len(set(words)) / n,
        "length": len(text) / n,
    }


def _band(x: float, low: float, good: float) -> int:
    """Low beyond ``low``, good up to ``good`` (in either direction), else nothing."""
    if low > good:
        return LOW if x > low else GOOD if x <= good else NONE
    return LOW if x < low else GOOD if x >= good else NONE


#: the labellers in order; each votes LOW, GOOD or NONE
LABELLERS = (
    lambda m: _band(m["words"], 5, 50),
    lambda m: _band(m["marked"], 0.15, 0.02),
    lambda m: _band(m["alone"], 0.15, 0.05),
    lambda m: _band(m["upper"], 0.5, 0.2),
    lambda m: _band(m["symbols"], 0.3, 0.1),
    lambda m: NONE if m["words"] < 20 else _band(m["ended"], 0.2, 0.5),
    lambda m: _band(m["lines_again"], 0.3, 0.1),
    lambda m: NONE if m["words"] < 20 else _band(m["stops"], 0.005, 0.02),
    lambda m: NONE if not m["words"] else _band(m["length"], 20, 12),
)


def pattern(text: str) -> int:
    """All votes on a text as one number, base 3."""
    code, m = 0, measures(text)
    for f in LABELLERS:
        code = code * 3 + f(m)
    return code


def votes(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        code, v = divmod(code, 3)
        out.append(v)
    return out[::-1]


def posteriors(counts: Mapping[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """Probability of being good for every pattern, and each labeller's rates (class, labeller, vote).

    Starts from the majority of votes, with labellers held to be right more
    often than wrong by pseudo-counts.
    """
    codes = sorted(counts)
    if not codes:
        return {}, np.full((2, len(LABELLERS), 3), 1 / 3)
    v, n = np.array([votes(c) for c in codes]), np.array([counts[c] for c in codes], float)
    one = np.eye(3)[v]
    q = (1 + (v == GOOD).sum(1)) / (2 + (v == GOOD).sum(1) + 2 * (v == LOW).sum(1))
    trust = 0.01 * n.sum() + 1
    prior = trust * np.array([[0.5, 0.1, 0.4], [0.1, 0.5, 0.4]])
    for _ in range(rounds):
        share = np.array([(n * (1 - q)).sum() + 0.1 * trust, (n * q).sum() + 0.1 * trust])
        rates = np.stack([np.einsum("i,ijv->jv", n * w, one) + prior[k] for k, w in ((0, 1 - q), (1, q))])
        rates /= rates.sum(2, keepdims=True)
        fit = np.log(share / share.sum()) + np.einsum("ijv,kjv->ik", one, np.log(rates))
        new = sigmoid(fit[:, 1] - fit[:, 0])
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return dict(zip(codes, q.tolist())), rates


KINDS = bytes(ord("0") if 48 <= b <= 57 else ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else b for b in range(256))
_runs = re.compile(rb"(.)\1{2,}", re.S)


def shape(word: bytes) -> bytes:
    """Kinds of characters in a word, runs cut to two."""
    return _runs.sub(rb"\1\1", word.translate(KINDS))[:12]


def slots(word: bytes) -> tuple[int, int]:
    return zlib.crc32(b"w" + word.lower()) % HASH, zlib.crc32(b"s" + shape(word)) % HASH


@dataclass
class Scorer:
    """Linear model: bias plus the mean weight of the words."""

    weights: np.ndarray
    bias: float
    known: dict[bytes, float] = field(default_factory=dict, repr=False)
    plain: list[float] = field(default_factory=list, repr=False)  # weights as numbers that single words look up faster
    shapes: dict[bytes, float] = field(default_factory=dict, repr=False)  # weight of a shape; few occur

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "plain": [], "shapes": {}}

    def _shape(self, kinds: bytes) -> float:
        w = self.plain[zlib.crc32(b"s" + _runs.sub(rb"\1\1", kinds)[:12]) % HASH]
        if len(kinds) < 40 and len(self.shapes) < CACHE_WORDS:
            self.shapes[kinds] = w
        return w

    def _word(self, word: bytes) -> float:
        if not self.plain:
            self.plain = self.weights.tolist()
        kinds = word.translate(KINDS)
        w = self.shapes.get(kinds)
        w = self.plain[zlib.crc32(b"w" + word.lower()) % HASH] + (self._shape(kinds) if w is None else w)
        if len(word) < 40 and len(self.known) < CACHE_WORDS:
            self.known[word] = w
        return w

    def score(self, text: str) -> float:
        row, known, make = text.encode().split(), self.known.get, self._word
        total = sum([w if (w := known(x)) is not None else make(x) for x in row])
        return float(sigmoid(self.bias + total / max(len(row), 1)))


def fit(rows: list[str], goal: list[float]) -> Scorer:
    """Logistic regression on posteriors, by full gradients."""
    if not rows:
        return Scorer(np.zeros(HASH), 0.0)
    ids: dict[bytes, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in t.encode().split()], np.int64) for t in rows]
    table = np.array([slots(w) for w in ids], np.int64).reshape(-1, 2)
    sizes = np.array([len(d) for d in docs])
    doc_at, word_at = np.repeat(np.arange(len(docs)), sizes), np.concatenate(docs)
    share, y = 1 / np.maximum(sizes, 1), np.array(goal)
    w, b, m, s = np.zeros(HASH), 0.0, np.zeros(HASH + 1), np.zeros(HASH + 1)
    for step in range(1, STEPS + 1):
        by_word = w[table].sum(1)
        miss = y - sigmoid(b + np.bincount(doc_at, by_word[word_at], len(docs)) * share)
        pull = np.bincount(word_at, (miss * share)[doc_at], len(ids))
        g = np.append(np.bincount(table.ravel(), np.repeat(pull, 2), HASH) / len(docs) * 100 - DECAY * w, miss.mean() * 100)
        m += 0.1 * (g - m)
        s += 0.02 * (g * g - s)
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-6)
        w, b = w + move[:-1], b + move[-1]
    return Scorer(w, float(b))


def with_patterns(docs: DataFrame) -> DataFrame:
    """doc_id and pattern of every whole text."""

    def run(batches):
        for batch in batches:
            for part in in_pieces(batch, 1024):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pattern(t) for t in texts(part.column(1))], pa.int32())], names=["doc_id", "pattern"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, pattern int")


@dataclass
class WeakQuality:
    posterior: dict[int, float]
    rates: np.ndarray
    scorer: Scorer


def train(docs: DataFrame, sample: int = SAMPLE) -> WeakQuality:
    """Vote patterns of all documents, then the linear model on at most ``sample`` of them, even over all rows by a hash."""
    counts = {r[0]: r[1] for r in with_patterns(docs).groupBy("pattern").count().collect()}  # at most 3^m rows
    posterior, rates = posteriors(counts)
    share = min(1.0, 4 * sample / max(sum(counts.values()), 1))
    some = docs.select("doc_id", "text").filter(F.length(text_or_empty()) <= SAMPLE_CHARS).withColumn("at", F.xxhash64("doc_id", "text"))
    some = some.filter(F.pmod("at", F.lit(1 << 20)) <= share * (1 << 20)).orderBy("at", "doc_id").limit(sample)
    rows = [r[0] or "" for r in some.select("text").collect()]
    return WeakQuality(posterior, rates, fit(rows, [posterior.get(pattern(t), 0.5) for t in rows]))


def scored(docs: DataFrame, model: WeakQuality) -> DataFrame:
    """doc_id, pattern, posterior, linear and score (mean of both as log-odds) of every whole text."""
    names = ["doc_id", "pattern", "posterior", "linear"]

    def run(batches):
        for batch in batches:
            for part in in_pieces(batch, 1024):
                rows = list(texts(part.column(1)))
                codes = [pattern(t) for t in rows]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(codes, pa.int32()), pa.array([model.posterior.get(c, 0.5) for c in codes], pa.float64()),
                    pa.array([model.scorer.score(t) for t in rows], pa.float64()),
                ], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, pattern int, posterior double, linear double")

    def odds(c):
        p = F.greatest(F.least(F.col(c), F.lit(1 - 1e-6)), F.lit(1e-6))
        return F.log(p / (1 - p))

    return out.withColumn("score", 1 / (1 + F.exp(-(odds("posterior") + odds("linear")) / 2)))
