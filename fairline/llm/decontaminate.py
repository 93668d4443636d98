"""Benchmark passages in documents: item-sized windows under SimHash.

A window is as long as a benchmark item, and is compared with items of its
length by the fingerprints of their five-word shingles.  Blocks of the
fingerprint's bits, one more than the radius, are the join keys, so every pair
within the radius is found; pairs are then kept by their exact similarity,
shingles weighted by how often they occur (sum of minima over sum of maxima).

Only windows that can be similar enough are fingerprinted.  Sliding a window to
the right until it starts with a shingle of the item loses none of the item's
shingles, so windows that start at such a shingle (or end with the document) are
enough; of those, windows without the needed number of shared shingles are out.
A document shorter than an item is one window.

DataFrame functions only.  Nulls count as empty texts.  Texts and items of less
than five words match nothing.  Rows are told apart by id and text, so repeated
rows give one result; a null id is an id like others (it is wrapped, as joins
lose nulls).  Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.llm.common import drop_keys, text_or_empty
from fairline.session import cut_lineage

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
#: distinct pairs of item and shingle that are broadcast; more are joined by a shuffle
BROADCAST_SHINGLES = 1_000_000
DOC = ("doc_id", "text_hash")


def shingles(text: Column, name: str = "shingles") -> Column:
    """Hashes of all five-word shingles in order; words stand between ASCII white space, in lower case."""
    words = F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")

    def runs(h):
        return F.transform(F.sequence(F.lit(1), F.size(h) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(h, i, SHINGLE)))

    # an array of one element names the hashed words, which are then computed once and not per shingle
    once = F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda h: F.when(F.size(h) >= SHINGLE, runs(h)))
    return once[0].alias(name)


def fingerprint(rows: DataFrame, *keys: str) -> DataFrame:
    """SimHash ``fp`` per key of shingles ``s`` that occur ``c`` times, and their number ``n``; a bit is 1 if it is in more than half."""
    counts = [f"sum((shiftright(s, {k}) & 1) * c) AS b{k}" for k in range(64)]
    bits = " | ".join(f"if(2 * b{k} > n, shiftleft(1L, {k}), 0L)" for k in range(64))
    return rows.groupBy(*keys).agg(F.sum("c").alias("n"), *[F.expr(c) for c in counts]).select(*keys, "n", F.expr(bits).alias("fp"))


def block_keys(fp: str, radius: int = RADIUS) -> Column:
    """Radius + 1 disjoint blocks of a fingerprint, each as number and bits: two fingerprints within the radius share one."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.expr(f"(shiftrightunsigned({fp}, {a}) & {(1 << b - a) - 1}L) * 64 + {k}") for k, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, item_id, first_word, n_words, differing_bits and similarity of every item found in a document.

    Of several windows the most similar one is given, the first among equals.
    """
    held = items.select("item_id", F.explode(shingles(text_or_empty())).alias("s"))
    held = cut_lineage(held, "item-shingles")
    sizes = held.groupBy("item_id").agg(F.count(F.lit(1)).alias("m"))
    known, pairs = held.select("s").distinct(), held.distinct()
    # there are no more shingles than pairs, so one count bounds both
    small = pairs.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES
    bounded = F.broadcast if small else (lambda df: df)

    read = docs.select(F.struct("doc_id").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), shingles(text_or_empty()))
    spots = read.select(*DOC, F.size("shingles").alias("total"), F.posexplode("shingles").alias("pos", "s"))
    hits = cut_lineage(spots.join(bounded(known), "s", "left_semi"), "hits")

    # positions of a document whose shingle an item has, numbered; a window needs enough of them
    pair = [*DOC, "item_id"]
    found = hits.join(bounded(pairs), "s").select(*pair, "total", "pos").distinct()
    enough = found.groupBy(*pair).agg(F.count(F.lit(1)).alias("shared")).join(sizes, "item_id")
    enough = enough.filter(F.col("shared") >= F.ceil(F.col("m") * similarity)).select(*pair, "m")
    found = cut_lineage(found.join(enough, pair), "found")
    need = F.ceil(F.least(F.lit(1.0), 2 * similarity / (1 + F.lit(similarity))) * F.col("m") - 1e-9)
    need = F.when(F.col("total") < F.col("m"), F.ceil(F.col("m") * similarity)).otherwise(need).cast("int")
    order = "row_number() over (partition by doc_id, text_hash, item_id order by pos)"
    numbered = found.withColumn("rank", F.expr(order)).withColumn("need", need)
    later = numbered.select(*pair, F.col("pos").alias("end"), F.col("rank").alias("last"))
    starts = numbered.withColumn("last", F.col("rank") + F.col("need") - 1).join(later, [*pair, "last"])
    starts = starts.filter(F.col("end") - F.col("pos") < F.col("m"))
    start = F.greatest(F.least(F.col("pos"), F.col("total") - F.col("m")), F.lit(0))
    windows = cut_lineage(starts.select(*DOC, "m", start.alias("start")).distinct(), "windows")

    # their shingles with counts; a repeated row's window is taken once
    window = [*DOC, "m", "start"]
    cut = F.expr("slice(shingles, start + 1, cast(m as int))")
    inside = read.join(windows, list(DOC)).select(*window, cut.alias("cut")).dropDuplicates(window)
    inside = inside.select(*window, F.explode("cut").alias("s")).groupBy(*window, "s").agg(F.count(F.lit(1)).alias("c"))
    inside = cut_lineage(inside, "inside")
    held = held.groupBy("item_id", "s").agg(F.count(F.lit(1)).alias("c"))

    # candidates within the radius by blocks, then the exact similarity
    mine = cut_lineage(fingerprint(inside, *window), "window-fingerprints").withColumn("block", F.explode(block_keys("fp", radius)))
    theirs = cut_lineage(fingerprint(held, "item_id"), "item-fingerprints").select("item_id", F.col("n").alias("m"), F.col("fp").alias("item_fp"), F.explode(block_keys("fp", radius)).alias("block"))
    near = mine.join(theirs, ["m", "block"]).withColumn("differing_bits", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
    near = near.filter(F.col("differing_bits") <= radius).select(*window, "n", "item_id", "differing_bits").distinct()
    common = near.join(inside, window).join(held.withColumnRenamed("c", "d"), ["item_id", "s"])
    common = common.groupBy(*window, "n", "item_id", "differing_bits").agg(F.sum(F.least("c", "d")).alias("both"))
    exact = common.withColumn("similarity", F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).filter(F.col("similarity") >= similarity)
    best = exact.groupBy(*pair).agg(F.max(F.struct("similarity", (-F.col("start")).alias("at"), "n", "differing_bits")).alias("best"))
    return best.select(
        F.col("doc_id.doc_id").alias("doc_id"), "text_hash", "item_id", (-F.col("best.at")).cast("long").alias("first_word"), (F.col("best.n") + SHINGLE - 1).alias("n_words"),
        F.col("best.differing_bits").alias("differing_bits"), F.col("best.similarity").alias("similarity"),
    )


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns as they were."""
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.col("text_hash").cast("string"))
    own = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.xxhash64(text_or_empty()).cast("string"))
    return drop_keys(docs, leaks(docs, items).select(key.alias("key")), own)
