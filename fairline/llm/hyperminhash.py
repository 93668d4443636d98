"""Near duplicates by HyperMinHash registers, banded, estimated and verified.

A document's set holds the hashes of its distinct shingles (runs of words between
ASCII white space, after A-Z are lower-cased; a text of fewer words is one
shingle).  The hash space is cut into buckets; a bucket's register keeps its
smallest hash in compressed form: the count of leading zeros and the first bits
behind them.  Empty buckets take the register of another bucket in an order fixed
per bucket, so registers of small sets agree as often as those of large ones.

Bands of registers are keys under which sets meet.  Inside a key, pairs of fitting
sizes whose estimated similarity, corrected for registers that agree by chance,
is not far below the threshold become candidates.  Components of candidates are then
decided by their exact sets of shingles: documents are linked by verified pairs
only.  Equal sets are one node, whatever their number.

A pair at the threshold shares no band with a chance of 5e-8 (``missed``), which is
the only way to lose a link.  Keys of more than ``CELL`` sets are cut into
parts, and every two parts meet in a cell.  Large components are cut by their
shingles: parts are first compared within themselves and with one pivot, and every
two parts meet only where that leaves more than one group.

Texts that are null, empty or without words have the empty set, which is linked
with nothing.  Rows without an id take the smallest id of their component, null if
there is none, and are kept only then.  Repeated rows are rows of their own with
the same component.  Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline.llm.common import in_pieces, row_key, texts
from fairline.llm.graph import components
from fairline.llm.simhash import set_links
from fairline.session import cut_lineage

SHINGLE, THRESHOLD = 2, (80, 100)
#: buckets (a power of two), and registers of a band
BUCKETS, BAND = 128, 4
#: bits of a register behind its leading zeros
MANTISSA = 10
#: standard deviations that an estimate may lie below the threshold
DEVIATIONS = 5.0
#: sets of a key that are compared together (twice as many in a cell of two parts), and rows that are searched in one go
CELL, CHUNK = 2048, 50_000
#: groups of a key up to this size are compared all at once
SMALL = 12
#: shingles, and sets, of a component's part
PART_SHINGLES, PART_SETS = 2_000_000, 8192

_KEY_BITS = 64 - int(math.log2(BUCKETS))


def missed(similarity: float, bands: int = BUCKETS // BAND, band: int = BAND) -> float:
    """Chance that two sets of this similarity share no band."""
    return (1 - similarity**band) ** bands


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes spread over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int = SHINGLE) -> np.ndarray:
    """Hashes of a whole text's distinct shingles, ascending."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    out = hashes[: len(words) - width + 1].copy()
    for k in range(1, width):
        out = mixed(out) + hashes[k : len(words) - width + 1 + k]
    return np.unique(mixed(out + np.uint64(width)))


@functools.lru_cache(maxsize=1)
def _detours() -> np.ndarray:
    """For each bucket, the buckets in the order in which it looks for a register."""
    random = np.random.default_rng(7)
    return np.array([random.permutation(BUCKETS) for _ in range(BUCKETS)])


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash of each ascending set, one row of 16-bit registers; empty sets have zeros."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    cuts = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(_KEY_BITS)
    low = np.uint64((1 << _KEY_BITS) - 1)
    for row, hashes in zip(out, sets):
        if not len(hashes):
            continue
        at = np.searchsorted(hashes, cuts)
        filled = np.append(at[1:], len(hashes)) > at
        smallest = hashes[at[filled]] & low  # ascending hashes: the first of a bucket is its smallest
        # zeros before the first one, from the exponent of the upper bits (rounding cannot carry: 53 bits are exact)
        lead = _KEY_BITS - np.frexp((smallest >> np.uint64(4)).astype(np.float64))[1] - 4
        lead = np.minimum(lead, _KEY_BITS - 4)
        behind = (smallest << (lead + 1).astype(np.uint64)) & low
        row[filled] = (lead.astype(np.uint64) << np.uint64(MANTISSA)) | (behind >> np.uint64(_KEY_BITS - MANTISSA))
        if not filled.all():
            order = _detours()[~filled]
            row[~filled] = row[order[np.arange(len(order)), filled[order].argmax(axis=1)]]
    return out


@functools.lru_cache(maxsize=1)
def chances() -> np.ndarray:
    """Chance that registers of two unrelated sets of 2^0, 2^1, ... shingles agree."""
    zeros = np.arange(_KEY_BITS - 4)[:, None]
    edges = 0.5 ** (zeros + 1) * (1 + np.arange((1 << MANTISSA) + 1) / (1 << MANTISSA))

    def of(load: float) -> float:
        cells = np.exp(-load * edges[:, :-1]) - np.exp(-load * edges[:, 1:])
        return float((cells**2).sum() / cells.sum() ** 2)

    return np.array([of(2.0**k / BUCKETS) for k in range(48)])


def estimated(agreeing: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Similarity of sets of about ``size`` shingles from the number of agreeing registers, less those that agree by chance."""
    by_chance = chances()[np.ceil(np.log2(np.maximum(size, 1))).astype(int)]
    return (agreeing / BUCKETS - by_chance) / (1 - by_chance)


def passing(agreeing: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Pairs that may be similar enough: sizes fit and the estimate is not far below the threshold."""
    few, many = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    share = THRESHOLD[0] / THRESHOLD[1]
    spread = np.sqrt(share * (1 - share) * (1 / BUCKETS + 2 / np.maximum(few, 1)))
    return (THRESHOLD[1] * few >= THRESHOLD[0] * many) & (estimated(agreeing, many) >= share - DEVIATIONS * spread)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, sig (128-bit digest of the set, null if empty) and regs of every row of ``docs`` (doc_id, text, key)."""

    def run(batches):
        for batch in batches:
            for part in in_pieces(batch):
                sets = [shingle_set(t) for t in texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                    pa.array([x.tobytes() for x in registers(sets)], pa.binary()),
                ], names=["doc_id", "key", "n_shingles", "sig", "regs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "key").mapInArrow(run, f"doc_id {kind}, key string, n_shingles long, sig binary, regs binary")


def banded(nodes: DataFrame) -> DataFrame:
    """band, value and node: one row per band of each node's registers."""

    def run(batches):
        for batch in batches:
            for part in in_pieces(batch, 2048):
                n = part.num_rows
                if n:
                    regs = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(n, -1)  # four registers of 16 bits
                    bands = regs.shape[1]
                    band = np.tile(np.arange(bands, dtype=np.int32), n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(band), pa.array(regs.ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), bands))], names=["band", "value", "node"])

    return nodes.select("node", "regs").mapInArrow(run, "band int, value long, node long")


def _forest(group: np.ndarray, node: np.ndarray, n: np.ndarray, regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs that connect, in each group of rows, what all its candidate pairs connect."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    out_a, out_b = [], []
    for size in range(2, SMALL + 1):  # few rows: all groups of one size at once
        first = starts[sizes == size]
        if not len(first):
            continue
        for i in range(size - 1):
            for j in range(i + 1, size):
                a, b = first + i, first + j
                good = passing((regs[a] == regs[b]).sum(axis=1), n[a], n[b])
                out_a.append(node[a[good]])
                out_b.append(node[b[good]])
    for at, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        mark = np.arange(size)
        for i in range(size - 1):
            others = np.flatnonzero(mark[i + 1 :] != mark[i]) + i + 1
            if not len(others):
                if (mark == mark[i]).all():
                    break
                continue
            js = at + others
            others = others[passing((regs[js] == regs[at + i]).sum(axis=1), n[js], np.full(len(js), n[at + i]))]
            for j in others.tolist():
                if mark[j] != mark[i]:
                    out_a.append(node[[at + i]])
                    out_b.append(node[[at + j]])
                    mark[mark == mark[j]] = mark[i]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def meeting(nodes: DataFrame) -> DataFrame:
    """band, value, node and n: bands whose value n sets have, two at least.  One shuffle of narrow rows."""
    w = Window.partitionBy("band", "value")
    return banded(nodes).withColumn("n", F.count(F.lit(1)).over(w)).filter("n > 1")


def candidates(nodes: DataFrame, met: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that connect all candidate pairs among nodes that share a value in ``met``."""
    parts = F.ceil(F.col("n") / cell).cast("int")
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(part, j) * parts + F.greatest(part, j))
    rows = met.select("band", "value", F.explode(cells).alias("cell"), "node").join(nodes.select("node", "n_shingles", "regs"), "node")
    order = ["band", "value", "cell"]
    dealt = rows.select(*order, "node", "n_shingles", "regs").repartition(*order).sortWithinPartitions(*order)

    def search(table: pa.Table):
        table = table.combine_chunks()
        keys = [table.column(c).to_numpy() for c in order]
        group = np.cumsum(np.r_[False, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(table.num_rows, -1)
        a, b = _forest(group, *(table.column(c).to_numpy() for c in ("node", "n_shingles")), regs)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            keys = [table.column(c).to_numpy() for c in order]
            cut = int(np.argmax(np.all([k == k[-1] for k in keys], axis=0)))  # the last group may go on
            if cut:
                yield search(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield search(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _lowest(nodes: list[int], links: list[tuple[int, int]]) -> list[int]:
    """Smallest node of each row's component under links between rows."""
    top = list(range(len(nodes)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, j in links:
        i, j = find(i), find(j)
        if nodes[i] > nodes[j]:
            i, j = j, i
        top[j] = i
    return [nodes[find(i)] for i in range(len(nodes))]


def _exact_stars(cells: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b and whole: every node with the smallest one that verified pairs of its cell join it to; ``cells`` has key, node, root, cell, label and whole."""
    read = docs.select("key", "text").join(cells, "key").dropDuplicates(["node", "root", "cell"])
    dealt = read.select("root", "cell", "node", "label", "whole", "text").repartition("root", "cell").sortWithinPartitions("root", "cell")

    def stars(nodes, labels, sets, whole):
        low = _lowest(nodes, set_links(sets, np.unique(labels, return_inverse=True)[1]))
        pairs = np.array([(a, b) for a, b in zip(nodes, low) if a != b], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array([whole] * len(pairs), pa.bool_())], names=["a", "b", "whole"])

    def run(batches):
        here, nodes, labels, sets, of_all = None, [], [], [], None
        for batch in batches:
            for part in in_pieces(batch):
                for root, cell, node, label, whole, text in zip(*(c.to_pylist() for c in part.columns)):
                    if (root, cell) != here:
                        if len(sets) > 1:
                            yield stars(nodes, labels, sets, of_all)
                        here, nodes, labels, sets, of_all = (root, cell), [], [], [], whole
                    nodes.append(node)
                    labels.append(label)
                    sets.append(shingle_set(text or ""))
        if len(sets) > 1:
            yield stars(nodes, labels, sets, of_all)

    return dealt.mapInArrow(run, "a long, b long, whole boolean")


def verified(nodes: DataFrame, roots: DataFrame, docs: DataFrame, shingles: int = PART_SHINGLES, sets: int = PART_SETS) -> DataFrame:
    """Components (node, root) of verified links; ``nodes`` has node, key and n_shingles, ``roots`` the candidate components (node, root)."""
    held = nodes.select("node", "key", "n_shingles").join(roots, "node")
    size = F.greatest(F.ceil(F.sum("n_shingles") / shingles), F.ceil(F.count(F.lit(1)) / sets))
    parts = held.groupBy("root").agg(size.cast("int").alias("parts"))
    held = held.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    held = cut_lineage(held, "candidates")
    # the root of a large component is the pivot that all its parts see
    everywhere = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    cells = held.select("key", "node", "root", F.explode(everywhere).alias("cell"), F.col("node").alias("label"), (F.col("parts") == 1).alias("whole"))
    first = cut_lineage(_exact_stars(cells, docs), "stars")
    done = first.filter("whole").select(F.col("a").alias("node"), F.col("b").alias("root"))
    large = held.filter("parts > 1")
    if large.isEmpty():
        return done
    some = first.filter("not whole").select("a", "b")
    known = cut_lineage(components(some), "members")
    labelled = large.join(known.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = labelled.groupBy("root").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("root")
    open_ = cut_lineage(open_, "open")
    if not open_.isEmpty():
        met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least("part", j) * F.col("parts") + F.greatest("part", j))
        cells = labelled.join(open_, "root").select("key", "node", "root", F.explode(met).alias("cell"), "label", F.lit(False).alias("whole"))
        known = components(some.unionByName(_exact_stars(cells, docs).select("a", "b")))
    return done.unionByName(known)


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    keyed = docs.select("doc_id", "text").withColumn("key", row_key())
    rows = cut_lineage(signatures(keyed), "registers")
    nodes = rows.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("lead"), F.min("key").alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = cut_lineage(components(candidates(nodes, meeting(nodes))), "near")
    members = cut_lineage(verified(nodes, roots, keyed), "members")
    led = nodes.select("sig", "lead", "node").join(members, "node", "left").select("sig", "lead", F.coalesce("root", "node").alias("root"))
    led = cut_lineage(led, "leads")
    found = led.join(led.groupBy("root").agg(F.min("lead").alias("component_id")), "root").select("sig", "component_id")
    alone = rows.filter("sig is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.select("sig", "doc_id", "n_shingles").join(found, "sig").select("doc_id", "n_shingles", "component_id").unionByName(alone)
