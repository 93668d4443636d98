"""Log-bilinear language model, trained by noise-contrastive estimation.

Words stand between ASCII white space, after A-Z are lower-cased; each text ends
with one end token.  Counts of all training tokens are summed per task and then
by word.  The model's vocabulary is the most frequent words, the end and one class
for all other words.  A context of two words is mapped by matrices to a predicted
feature vector; its product with a word's vector plus a bias is the word's score.

Training goes once over all training texts: every task follows the gradient of
noise-contrastive estimation from the same start, with noise from the unigram
distribution shared by a batch, and the results are averaged, weighted by their
tokens.  Scores are normalised exactly: the normaliser depends on the context
alone, so it is worked out for all pairs of context words by matrix products.
Words outside the vocabulary divide their class's probability by add-one counts.

Counts of the ``HEAD`` most frequent words go to all workers (a fixed bound); the
others are looked up by a join, so no hot word is ever shuffled row by row.

Null texts count as empty and hold just the end token.  Null ids count as the
empty text in the split.  Repeated rows give repeated rows and count each.  Without
training texts every word is unseen and the base score is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.common import in_pieces, texts
from fairline.llm.toxic_crf import held_out
from fairline.session import cut_lineage

#: classes of the model (with end and other), length of feature vectors, words whose counts all workers hold
CLASSES, WIDTH, HEAD = 1024, 16, 200_000
#: tokens of a training step, noise words it shares, step size of AdaGrad
BATCH, NOISE, RATE = 4096, 64, 0.1
#: distinct words that a task sums before it hands them on, and models that are averaged at once
HELD_WORDS, FAN_IN = 300_000, 32
OTHER, END = 0, 1
END_WORD = b""


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word and c over all texts; the end token is the empty word."""

    def emit(held):
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for t in texts(batch.column(0)):
                held.update(words(t))
                held[END_WORD] += 1
                if len(held) >= HELD_WORDS:
                    yield emit(held)
                    held.clear()
        yield emit(held)

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The most frequent words with their counts, and totals over all training tokens."""

    head: dict[bytes, int]
    counts: np.ndarray
    total: int
    distinct: int
    classes: int
    end: int = 0

    @property
    def n_words(self) -> int:
        """Words of the vocabulary that have a class of their own (end apart)."""
        return min(self.classes - 2, len(self.head))

    def ids(self, text: str) -> np.ndarray:
        """Rank of every word among the head words, -1 for others."""
        get = self.head.get
        return np.array([get(w, -1) for w in words(text)], np.int64)

    def classed(self, ids: np.ndarray) -> np.ndarray:
        """Classes of a text's words, and the end."""
        return np.append(np.where((ids >= 0) & (ids < self.n_words), ids + 2, OTHER), END)

    def unigram(self) -> np.ndarray:
        own = self.counts[: self.n_words]
        p = np.concatenate([[self.total - own.sum() - self.end, self.end], own]) + 1.0
        return p / p.sum()

    def other(self) -> tuple[int, int]:
        """Training tokens and distinct words outside the vocabulary."""
        seen = (self.end > 0) + self.n_words
        return int(self.total - self.end - self.counts[: self.n_words].sum()), self.distinct - seen


def head_words(words: DataFrame, head: int) -> DataFrame:
    """The most frequent words, at most ``head`` rows.

    The count at the cut is found from sizes of classes of counts, so that no
    partition sends its own top rows to the driver.  Of words tied at the cut
    those with small hashes are taken, or none if these were too many.
    """
    level = F.floor(F.log2("c") * 8)
    above = 0
    for step, n in sorted(words.groupBy(level).count().collect(), reverse=True):  # at most 8 per power of two
        if above + n > head:
            break
        above += n
    else:
        return words
    for cut, n in sorted(words.filter(level == step).groupBy("c").count().collect(), reverse=True):  # counts of one level
        if above + n > head:
            break
        above += n
    room = max(0, head - above - 3 * math.isqrt(head - above))  # hashes scatter around the share that is asked for
    tied = (F.col("c") == cut) & (F.pmod(F.xxhash64("word"), F.lit(1 << 31)) < room * (1 << 31) // n)
    picked = words.filter((F.col("c") > cut) | tied)
    return picked if picked.count() <= head else words.filter(F.col("c") > cut)


def lexicon(counts: DataFrame, classes: int = CLASSES, head: int = HEAD) -> Lexicon:
    total, distinct, end = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("word") == "", F.col("c")))).first()
    rows = sorted(head_words(counts.filter("word <> ''"), head).collect(), key=lambda r: (-r[1], r[0]))
    return Lexicon({r[0].encode(): k for k, r in enumerate(rows)}, np.array([r[1] for r in rows], np.int64), total or 0, distinct, classes, end or 0)


@dataclass
class Model:
    """Word vectors as context (r) and as target (q), context matrices, biases."""

    r: np.ndarray
    q: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    b: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, width: int = WIDTH) -> "Model":
        rng, n = np.random.default_rng(7), len(unigram)
        eye = np.eye(width)
        return cls(rng.normal(0, 0.1, (n, width)), rng.normal(0, 0.1, (n, width)), eye * 0.5, eye * 0.25, np.log(unigram))

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.q, self.c1, self.c2, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def shaped(self, flat: np.ndarray) -> "Model":
        cuts = np.cumsum([x.size for x in self.parts()])[:-1]
        return Model(*[y.reshape(x.shape) for x, y in zip(self.parts(), np.split(flat, cuts))])

    def normalisers(self, before: np.ndarray) -> np.ndarray:
        """Log of the sum of all words' weights, for contexts of each word in ``before`` and then any word."""
        near, far = self.r @ self.c1, self.r[before] @ self.c2
        q, b = self.q.T.astype(np.float32), self.b.astype(np.float32)
        out = np.empty((len(before), len(self.r)), np.float32)
        for k, x in enumerate(far):
            s = (near + x).astype(np.float32) @ q + b
            top = s.max(1)
            out[k] = np.log(np.exp(s - top[:, None]).sum(1)) + top
        return out

    def log_probabilities(self, z: np.ndarray, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> np.ndarray:
        hat = (self.r @ self.c1)[near] + (self.r @ self.c2)[far]
        return np.einsum("ij,ij->i", hat, self.q[word]) + self.b[word] - z[far, near]


def contexts(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two words before each word; before the first stand ends."""
    padded = np.concatenate([[END, END], classes])
    return padded[:-2], padded[1:-1]


def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, v, n) for v in values.T], axis=1)


class Trainer:
    """Steps of noise-contrastive estimation on batches of (far, near, word)."""

    def __init__(self, model: Model, unigram: np.ndarray, seed: int = 0):
        self.m, self.unigram, self.log_noise = model, unigram, np.log(unigram * NOISE)
        self.cumulated = np.cumsum(unigram)
        self.seen = [np.full_like(x, 1e-2) for x in model.parts()]
        self.rng, self.tokens = np.random.default_rng(seed), 0

    def step(self, far, near, word) -> None:
        m, n = self.m, len(self.m.b)
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), n - 1)
        r1, r2 = m.r[near], m.r[far]
        hat = r1 @ m.c1 + r2 @ m.c2
        real = np.einsum("ij,ij->i", hat, m.q[word]) + m.b[word] - self.log_noise[word]
        fake = hat @ m.q[noise].T + (m.b[noise] - self.log_noise[noise])
        up = 1 / (1 + np.exp(np.clip(real, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(fake, -30, 30)))
        d_hat = up[:, None] * m.q[word] + down @ m.q[noise]
        d_q = summed(word, up[:, None] * hat, n)
        np.add.at(d_q, noise, down.T @ hat)
        d_b = np.bincount(word, up, n)
        np.add.at(d_b, noise, down.sum(0))
        d_r = summed(near, d_hat @ m.c1.T, n) + summed(far, d_hat @ m.c2.T, n)
        size = len(word)
        for x, g, s in zip(m.parts(), (d_r, d_q, r1.T @ d_hat, r2.T @ d_hat, d_b), self.seen):
            g = g / size
            s += g * g
            x += RATE * g / np.sqrt(s)
        self.tokens += size


def train(docs: DataFrame, lex: Lexicon) -> Model:
    """One pass over all texts of ``docs``; the tasks' models are averaged, ``FAN_IN`` at a time."""
    spark, unigram = docs.sparkSession, lex.unigram()
    shared = spark.sparkContext.broadcast(lex)
    schema = "tokens double, model binary"

    def learn(batches):
        lex = shared.value
        trainer, held, n = Trainer(Model.start(unigram), unigram), [], 0
        for batch in batches:
            for t in texts(batch.column(0)):
                classes = lex.classed(lex.ids(t))
                held.append((*contexts(classes), classes))
                n += len(classes)
                if n >= BATCH:
                    rows = [np.concatenate(x) for x in zip(*held)]
                    for at in range(0, n - BATCH + 1, BATCH):
                        trainer.step(*[x[at : at + BATCH] for x in rows])
                    held = [tuple(x[n - n % BATCH :] for x in rows)]
                    n %= BATCH
        if n:
            trainer.step(*[np.concatenate(x) for x in zip(*held)])
        if trainer.tokens:
            yield pa.RecordBatch.from_arrays([pa.array([float(trainer.tokens)]), pa.array([trainer.m.flat().tobytes()])], names=["tokens", "model"])

    def mean(batches):
        total, weight = 0.0, 0.0
        for batch in batches:
            for w, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total, weight = total + w * np.frombuffer(blob), weight + w
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(total / weight).tobytes()])], names=["tokens", "model"])

    models = cut_lineage(docs.select("text").mapInArrow(learn, schema), "models")
    while (n := models.count()) > FAN_IN:
        models = cut_lineage(models.repartition(-(-n // FAN_IN)).mapInArrow(mean, schema), "models")
    rows = models.collect()  # at most FAN_IN
    shared.unpersist()
    start = Model.start(unigram)
    if not rows:
        return start
    weight = sum(r[0] for r in rows)
    return start.shaped(sum(r[0] / weight * np.frombuffer(bytes(r[1])) for r in rows))


def normaliser_table(spark, model: Model) -> np.ndarray:
    """Normalisers of all contexts, a row per far word, worked out by tasks."""
    n = len(model.b)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at in range(0, len(ids), 32):
                z = model.normalisers(ids[at : at + 32])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 32]), pa.array([x.tobytes() for x in z])], names=["id", "z"])

    rows = spark.range(n, numPartitions=max(1, min(32, n // 32))).mapInArrow(run, "id long, z binary").collect()  # classes squared numbers
    out = np.empty((n, n), np.float32)
    for r in rows:
        out[r[0]] = np.frombuffer(bytes(r[1]), np.float32)
    return out


def score_documents(docs: DataFrame, folds: int = 7, fold: int = 2, classes: int = CLASSES, head: int = HEAD) -> DataFrame:
    """Learn from the texts outside ``fold`` and score all: see the query's contract for the columns."""
    spark = docs.sparkSession
    training = docs.select("doc_id", "text").filter(~held_out("doc_id", folds, fold))
    counts = cut_lineage(word_counts(training), "word-counts")
    lex = lexicon(counts, classes, head)
    model = train(training, lex)
    other_n, other_v = lex.other()
    shared = spark.sparkContext.broadcast((lex, model, normaliser_table(spark, model)))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "n_other", "base", "score", "rest"]
    item = pa.struct([("word", pa.string()), ("n", pa.int32())])

    def run(batches):
        lex, model, z = shared.value
        logs = np.log10(lex.counts + 1.0)
        end_known, end_log = int(lex.end > 0), np.log10(lex.end + 1.0)
        for batch in batches:
            for part in in_pieces(batch, 512):
                known, other, base, score, sizes, rest = [], [], [], [], [], []
                for t in texts(part.column(2)):
                    ids = lex.ids(t)
                    c = lex.classed(ids)
                    inside = ids >= 0
                    known.append(int(inside.sum()) + end_known)
                    other.append(int((c == OTHER).sum()))
                    base.append(float(logs[ids[inside]].sum() + end_log))
                    score.append(float(model.log_probabilities(z, *contexts(c), c).sum() / np.log(10) + logs[ids[ids >= lex.n_words]].sum()))
                    sizes.append(len(c))
                    more = Counter(w for w, here in zip(words(t), inside.tolist()) if not here) if not inside.all() else {}
                    rest.append([{"word": w.decode(), "n": n} for w, n in more.items()])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(other, pa.int64()),
                    pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(rest, pa.list_(item)),
                ], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "text")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, n_other long, base double, score double, rest array<struct<word:string,n:int>>"
    rows = cut_lineage(read.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")

    # words beyond the head words, by a join with their counts
    rest = rows.select("row", F.inline("rest")).join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    more = rest.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(c + 1)).alias("rest_log"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rest_known"))
    size = np.log10(lex.total + lex.distinct + 1)
    own = np.log10(other_n + other_v + 1)
    out = rows.drop("rest").join(more, "row", "left")
    log, seen = F.coalesce("rest_log", F.lit(0.0)), F.coalesce("rest_known", F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + seen).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.lit(float(size))).alias("base_score"),
        (F.col("score") + log - F.col("n_other") * F.lit(float(own))).alias("score"),
    )
