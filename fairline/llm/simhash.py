"""Near duplicates by SimHash, searched with a Gray-order hierarchical index.

Words stand between ASCII white space, after A-Z are lower-cased; shingles are
runs of words, repeats included (a shorter text is one shingle).  A fingerprint
bit is 1 if it is 1 in more than half of the shingles' hashes; texts without
words have the fingerprint zero.  Fingerprints link when they differ in at most
``radius`` bits.

Distinct fingerprints are dealt into buckets by blocks of their bits.  With more
disjoint blocks than the radius has bits, two linked fingerprints agree in one
block at least, so no link is lost (``Spec.exact``).  With a wide radius blocks
are a search with known recall: see ``Spec.recall``.  Inside a bucket the
hierarchy of ``gray_index`` finds the links that join components.  A bucket of
more than ``CELL`` rows is cut into parts by hash, and every two parts meet in a
cell of their own, so no task holds a whole hot bucket.  Only links that join
components leave a cell.

``drop_near_copies`` takes such components as candidates only.  It fingerprints
distinct shingles and compares the sets of shingles inside a component exactly, by
their 64-bit hashes: documents are joined by verified links alone.

Null texts count as empty.  Equal texts share one fingerprint row.  Null ids get
the component of their fingerprint, whose id is the smallest that is not null.
Empty tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.common import drop_keys, in_pieces, row_key, texts
from fairline.llm.gray_index import bucket_links
from fairline.llm.graph import components
from fairline.session import cut_lineage

SEED = 42
#: rows of a bucket that are searched together (twice as many in a cell of two parts)
CELL = 16_384
#: rows whose buckets are searched in one go
CHUNK = 100_000
#: sets of shingles of a candidate component that are compared together (twice as many in a cell of two parts)
SET_CELL = 2048
#: candidates that are compared without looking for common rare shingles first
FEW = 64
#: shingles whose bits are unpacked at once
SHINGLES = 16_384


@dataclass(frozen=True)
class Spec:
    """What a fingerprint is and how links are searched."""

    shingle: int = 4
    bits: int = 64
    radius: int = 4
    n_blocks: int = 5
    block_bits: int | None = None
    distinct: bool = False  # repeated shingles count once
    carried: int | None = None  # first bits, which the radius is about; all if not given

    @property
    def blocks(self) -> list[tuple[int, int]]:
        """First bit and width of each block; blocks are disjoint and share all bits, or the first ones of ``block_bits`` each."""
        used = self.n_blocks * self.block_bits if self.block_bits else self.bits
        cuts = [used * k // self.n_blocks for k in range(self.n_blocks + 1)]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:])]

    @property
    def exact(self) -> bool:
        return self.n_blocks > self.radius

    def same(self, similarity: float) -> float:
        """Chance that a bit agrees at this Jaccard similarity (distinct shingles, sets of one size)."""
        return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi

    def recall(self, similarity: float) -> float:
        """Expected share of pairs with this Jaccard similarity that agree in a block."""
        miss = 1.0
        for _, width in self.blocks:
            miss *= 1 - self.same(similarity) ** width
        return 1 - miss

    def accepted(self, similarity: float) -> float:
        """Expected share of pairs with this Jaccard similarity that differ in at most ``radius`` bits."""
        p, n = 1 - self.same(similarity), self.carried or self.bits
        return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(self.radius + 1))


#: four words, 64 bits, four differing bits: an exact search
CONTRACT = Spec()
#: five words: blocks and radius find candidates at a similarity of 0.8 almost surely, which sets of shingles then decide
FIVE_WORDS = Spec(shingle=5, bits=1024, radius=113, n_blocks=73, block_bits=14, distinct=True, carried=512)


def shingles(text: str, spec: Spec) -> np.ndarray:
    """Hashes of a whole text's shingles in their order, or ascending and each once."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    joined, width = b" ".join(words), min(spec.shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    return np.unique(hashes) if spec.distinct else hashes


def fingerprint(text: str, spec: Spec = CONTRACT) -> bytes:
    """Fingerprint of a whole text, most significant bit first."""
    return majority(shingles(text, spec), spec)


def majority(hashes: np.ndarray, spec: Spec) -> bytes:
    ones = np.zeros(spec.bits, np.int64)
    for at in range(0, len(hashes), SHINGLES):
        lanes = widened(hashes[at : at + SHINGLES], spec.bits // 64)
        ones += column_sums(np.unpackbits(lanes.astype(">u8").view(np.uint8), axis=1))
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of columns of 0 and 1: bytes hold sums of 255 rows, which adds many at once."""
    whole = len(bits) // 255 * 255
    sums = bits[whole:].sum(axis=0, dtype=np.uint8).astype(np.int64)
    if whole:
        sums += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return sums


def widened(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """Rows of ``lanes`` words: the hash itself, then mixes of it."""
    out = np.empty((len(hashes), lanes), np.uint64)
    out[:, 0] = hashes
    for k in range(1, lanes):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def fingerprints(docs: DataFrame, spec: Spec) -> DataFrame:
    """doc_id, key and fp (binary) of every row of ``docs`` (doc_id, text, key)."""

    def run(batches):
        for batch in batches:
            for part in in_pieces(batch):
                fps = pa.array([fingerprint(t, spec) for t in texts(part.column(1))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), fps], names=["doc_id", "key", "fp"])

    kinds = [docs.schema[c].dataType.simpleString() for c in ("doc_id", "key")]
    return docs.select("doc_id", "text", "key").mapInArrow(run, f"doc_id {kinds[0]}, key {kinds[1]}, fp binary")


def as_lanes(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), ">u8").reshape(len(rows), -1).astype(np.uint64)


def bucketed(nodes: DataFrame, spec: Spec, with_fp: bool) -> DataFrame:
    """One row per block of each fingerprint: bucket (block and its bits), node and fp if wanted."""

    def run(batches):
        for batch in batches:
            for part in in_pieces(batch, 2048):
                if not part.num_rows:
                    continue
                fps = pc.binary_slice(part.column(1), 0, spec.carried // 8) if spec.carried else part.column(1)
                bits = np.unpackbits(as_lanes(part.column(1)).astype(">u8").view(np.uint8), axis=1)
                for k, (start, width) in enumerate(spec.blocks):
                    value = bits[:, start : start + width].astype(np.int64) @ (1 << np.arange(width, dtype=np.int64)[::-1])
                    bucket = pa.array(value + (k << 40))
                    yield pa.RecordBatch.from_arrays([bucket, part.column(0), fps] if with_fp else [bucket], names=["bucket", "node", "fp"][: 3 if with_fp else 1])

    return nodes.select("node", "fp").mapInArrow(run, "bucket long" + ", node long, fp binary" * with_fp)


def links(nodes: DataFrame, spec: Spec, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between nodes that keep all components of the links of ``spec``."""
    large = bucketed(nodes, spec, False).groupBy("bucket").count().filter(F.col("count") > cell)
    large = cut_lineage(large.select("bucket", F.ceil(F.col("count") / cell).cast("int").alias("parts")), "large-buckets")
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    met = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(part, j) * parts + F.greatest(part, j))
    rows = bucketed(nodes, spec, True).join(large, "bucket", "left").select("bucket", F.explode(met).alias("cell"), "node", "fp")
    dealt = rows.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")
    radius = spec.radius

    def search(table: pa.Table):
        table = table.combine_chunks()
        b, c = (table.column(k).to_numpy() for k in ("bucket", "cell"))
        node = table.column("node").to_numpy()
        group = np.cumsum(np.r_[False, (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
        got = bucket_links(group, as_lanes(table.column("fp")), radius)
        i, j = np.array(got, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < CHUNK:
                continue
            # the last group may go on in the next batch
            rows = pa.Table.from_batches(held)
            b, c = (rows.column(k).to_numpy() for k in ("bucket", "cell"))
            cut = int(np.argmax((b == b[-1]) & (c == c[-1])))
            if cut:
                yield search(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield search(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, spec: Spec = CONTRACT) -> DataFrame:
    """doc_id, key, fp and component_id of every row; ``docs`` has doc_id, text and key."""
    rows = cut_lineage(fingerprints(docs, spec), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("lead"))
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = cut_lineage(components(links(nodes, spec)), "members")
    led = nodes.select("node", "lead").join(members, "node")
    leads = led.groupBy("root").agg(F.min("lead").alias("component_id"))
    known = members.join(leads, "root").select("node", "component_id")
    by_fp = nodes.join(known, "node", "left").select("fp", F.coalesce("component_id", "lead").alias("component_id"))
    return rows.join(by_fp, "fp").select("doc_id", "key", "fp", "component_id")


def signatures(docs: DataFrame, spec: Spec) -> DataFrame:
    """doc_id, key, fp and sig (128-bit digest of the set of shingles) of every row of ``docs``; ``spec`` has distinct shingles."""

    def run(batches):
        for batch in batches:
            for part in in_pieces(batch):
                sets = [shingles(t, spec) for t in texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array([majority(x, spec) for x in sets], pa.binary()),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                ], names=["doc_id", "key", "fp", "sig"])

    kinds = [docs.schema[c].dataType.simpleString() for c in ("doc_id", "key")]
    return docs.select("doc_id", "text", "key").mapInArrow(run, f"doc_id {kinds[0]}, key {kinds[1]}, fp binary, sig binary")


def set_links(sets: list[np.ndarray], label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs at a Jaccard similarity of 0.8 or more that keep all components of such pairs.

    A pair is left out only if verified links join it already (``label`` has groups
    known before), if its sizes are too far apart, or if none of the rarest shingles
    is common, of which a pair at 0.8 must share one.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    _, codes, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    order = np.lexsort([codes, often[codes], row])
    codes, ends = codes[order], np.cumsum(sizes)
    starts = ends - sizes
    rare = np.where(sizes > 0, sizes - (4 * sizes + 4) // 5 + 1, 0)
    leads = np.flatnonzero(np.arange(len(codes)) - starts[row] < rare[row])
    leads = leads[np.argsort(codes[leads], kind="stable")]
    lead_codes, lead_rows = codes[leads], row[leads]
    mark, out = np.zeros(len(often), bool), []
    label = np.arange(n) if label is None else label.copy()

    def spans(first, last):
        size = last - first
        return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())

    for i in range(n - 1):
        a = sizes[i]
        js = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        js = js[5 * np.minimum(sizes[js], a) >= 4 * np.maximum(sizes[js], a)]
        if a and len(js) > FEW:
            mine = codes[starts[i] : starts[i] + rare[i]]
            js = np.intersect1d(js, lead_rows[spans(np.searchsorted(lead_codes, mine), np.searchsorted(lead_codes, mine, "right"))])
        if not len(js):
            continue
        if a:
            mark[codes[starts[i] : ends[i]]] = True
            both = np.add.reduceat(mark[codes[spans(starts[js], ends[js])]], np.cumsum(sizes[js]) - sizes[js], dtype=np.int64)
            mark[codes[starts[i] : ends[i]]] = False
            js = js[5 * both >= 4 * (a + sizes[js] - both)]
        for j in js.tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def verified(candidates: DataFrame, spec: Spec) -> DataFrame:
    """Edges (a, b) between sets that keep all components of verified links; ``candidates`` has root, cell, node and text."""

    def links_of(nodes: list[int], sets: list[np.ndarray]):
        got = np.array(set_links(sets), np.int64).reshape(-1, 2)
        at = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at[got[:, 0]]), pa.array(at[got[:, 1]])], names=["a", "b"])

    def run(batches):
        here, nodes, sets = None, [], []
        for batch in batches:
            for part in in_pieces(batch):
                for root, cell, node, text in zip(*(c.to_pylist() for c in part.columns)):
                    if (root, cell) != here:
                        if len(sets) > 1:
                            yield links_of(nodes, sets)
                        here, nodes, sets = (root, cell), [], []
                    nodes.append(node)
                    sets.append(shingles(text or "", spec))
        if len(sets) > 1:
            yield links_of(nodes, sets)

    dealt = candidates.select("root", "cell", "node", "text").repartition("root", "cell").sortWithinPartitions("root", "cell")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def verified_groups(docs: DataFrame, spec: Spec = FIVE_WORDS, cell: int = SET_CELL) -> DataFrame:
    """doc_id, key and component_id of every row: components of pairs at 0.8 or more; ``docs`` has doc_id, text and key."""
    rows = cut_lineage(signatures(docs, spec), "signatures")
    nodes = cut_lineage(rows.select("fp").distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    near = cut_lineage(components(links(nodes, spec)), "near")
    roots = nodes.join(near, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    sets = rows.groupBy("sig").agg(F.min("fp").alias("fp"), F.min("key").alias("key"), F.min("doc_id").alias("lead"))
    sets = cut_lineage(sets.join(roots, "fp").select("sig", "key", "lead", "root", F.monotonically_increasing_id().alias("node")), "sets")

    # sets of one candidate component, every two parts of a large one in a cell of their own
    many = sets.groupBy("root").count().filter("count > 1").select("root", F.ceil(F.col("count") / cell).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(part, j) * F.col("parts") + F.greatest(part, j))
    some = sets.join(many, "root").select("key", "root", "node", met.alias("cells"))
    read = docs.select("key", "text").join(some, "key").dropDuplicates(["key"])
    edges = verified(read.select("root", F.explode("cells").alias("cell"), "node", "text"), spec)

    members = cut_lineage(components(edges), "members")
    leads = sets.join(members.withColumnRenamed("root", "top"), "node", "left").select("sig", "lead", F.coalesce("top", "node").alias("top"))
    leads = cut_lineage(leads, "tops")
    first = leads.groupBy("top").agg(F.min("lead").alias("component_id"))
    return rows.join(leads.join(first, "top").select("sig", "component_id"), "sig").select("doc_id", "key", "component_id")


def drop_near_copies(docs: DataFrame, spec: Spec = FIVE_WORDS) -> DataFrame:
    """``docs`` with one document of each component of verified links, the one with the smallest id; all columns as they were.

    Rows without an id go where their component has a document with one.
    """
    keyed = docs.select("doc_id", "text", row_key().alias("key"))
    groups = verified_groups(keyed, spec).filter("component_id is not null and not doc_id <=> component_id")
    return drop_keys(docs, groups.select("key"), row_key())
