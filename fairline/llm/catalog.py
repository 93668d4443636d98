"""Registered queries of the operators in this folder, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm import align, bpe, decontaminate, exact_dedup, hyperminhash, lbl_lm, license_rules, pca_clusters, simhash, slots, token_rollup, toxic_crf, weak_quality
from fairline.llm.common import table
from fairline.session import cut_lineage, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer lies; the same on all executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Totals over all documents by source, language and tokenizer version, after load, revision, strays that are deleted again and a repeated batch."""
    docs = table(spark, sf, "documents")
    versions = {"byte_bpe_50k": tokenizer_file(), "words": None}
    counted = cut_lineage(token_rollup.count_tokens(docs, versions), "token-counts")
    return token_rollup.corpus_rollup(docs, versions, scratch_path(spark, "rollup"), counted).totals()


def op2_virtual_slots(spark: SparkSession, sf: str, n_shards: int = 40) -> DataFrame:
    """Every document's shard and its place there; shards are near equal in bytes."""
    rows = slots.slotted(table(spark, sf, "documents"))
    weights, counts = slots.slot_weights(rows)
    path = scratch_path(spark, "slot-map")
    even = slots.SlotMap.even(n_shards)
    even.save(spark, path)
    even.rebalanced(weights).save(spark, path)
    out = slots.sharded(rows, slots.SlotMap.load(spark, path), counts)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op3_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    return bpe.digests(bpe.encode_documents(table(spark, sf, "documents"), tokenizer_file()))


def op4_simhash_gray(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("key"))
    return simhash.near_groups(docs).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op5_lbl_lm(spark: SparkSession, sf: str) -> DataFrame:
    """Log-probability of every document under the unigram base and the log-bilinear model."""
    return lbl_lm.score_documents(table(spark, sf, "documents"))


def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item that a document holds, with place and similarity; clean documents have no row."""
    found = decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "n_words", "differing_bits", F.round("similarity", 9).alias("similarity"))


def op7_license_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    found = license_rules.scan(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", *license_rules.SUMMARY)


def op8_toxic_crf(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score and toxic spans of every document; a fifth of the ids is never trained on."""
    docs = table(spark, sf, "documents")
    model = toxic_crf.train(docs, table(spark, sf, "labels"))
    out = toxic_crf.tagged(docs, model)
    return out.select("doc_id", toxic_crf.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op10_weak_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document from weak labels and the linear model trained on them."""
    docs = table(spark, sf, "documents")
    out = weak_quality.scored(docs, weak_quality.train(docs))
    return out.select("doc_id", "score", "posterior", "linear", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("kept"))


def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the copy that stays and the size of its group."""
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


def op11_cross_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and links between the tokens of two vocabularies, with corpus-wide counts of linked ids."""
    return align.summaries(table(spark, sf, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))


def op12_pca_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster, distance and inertia of every vector after three exact rounds."""
    return pca_clusters.with_inertia(*pca_clusters.clusters(pca_clusters.integer_vectors(table(spark, sf, "embeddings"))))


def op13_hyperminhash(spark: SparkSession, sf: str) -> DataFrame:
    """Component of every document under verified links of two-word shingles."""
    groups = hyperminhash.near_groups(table(spark, sf, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""



def op12_sql(k: int = pca_clusters.CENTROIDS, rounds: int = pca_clusters.ROUNDS) -> str:
    """Every round as three tables: distances, assignment, centroids."""
    steps = [rf"""k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM k ORDER BY h, v LIMIT {k}))"""]
    for n in range(rounds + 1):
        steps.append(f"""d{n} AS (SELECT k.r, k.vec_id, k.v, c{n}.c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c{n}.v[i]) * (k.v[i] - c{n}.v[i])))::BIGINT AS d FROM k, c{n}),
a{n} AS (SELECT * FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < rounds:
            steps.append(f"""m{n} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY c, i),
c{n + 1} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM m{n} GROUP BY c UNION ALL SELECT c, v FROM c{n} WHERE c NOT IN (SELECT c FROM m{n}))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(z.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} z ON a.c = z.c"""


OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
z AS (SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
g AS (SELECT s, min(r) AS node, len(s) AS n FROM (SELECT r, list_sort(s) AS s FROM z WHERE len(s) > 0) GROUP BY s),
e AS (SELECT node, n, unnest(s) AS x FROM g),
p AS (SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.x = b.x AND a.node <> b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
c AS (SELECT node AS a, node AS b FROM g UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a),
m AS (SELECT z.r, z.doc_id, len(z.s) AS n, g.node FROM z LEFT JOIN g ON list_sort(z.s) = g.s),
l AS (SELECT node, min(doc_id) AS lead FROM m WHERE node IS NOT NULL GROUP BY node),
k AS (SELECT c.a AS node, min(l.lead) AS component_id FROM c JOIN l ON c.b = l.node GROUP BY c.a)
SELECT m.doc_id, m.n::BIGINT AS n_shingles, CASE WHEN m.node IS NULL THEN m.doc_id ELSE k.component_id END AS component_id,
  m.doc_id IS NOT DISTINCT FROM (CASE WHEN m.node IS NULL THEN m.doc_id ELSE k.component_id END) AS kept
FROM m LEFT JOIN k ON m.node = k.node
"""

QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_token_rollup, op2_virtual_slots, op3_bpe, op4_simhash_gray, op5_lbl_lm, op6_decontaminate, op7_license_rules, op8_toxic_crf,
    op9_exact_dedup, op10_weak_quality, op11_cross_tokens, op12_pca_clusters, op13_hyperminhash,
)}
SQL: dict[str, str] = {"op9_exact_dedup": OP9_SQL, "op12_pca_clusters": op12_sql(), "op13_hyperminhash": OP13_SQL}
