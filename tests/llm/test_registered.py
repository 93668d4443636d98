"""Registered queries on tables with all awkward rows: contract columns, brute force, empty tables."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fairline.llm import align, catalog, hyperminhash, pca_clusters
from fairline.session import cut_lineage

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block long, node long, label string, root string"
CONTRACT = {
    "op2_virtual_slots": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_simhash_gray": "doc_id bigint, fingerprint string, component_id bigint",
    "op5_lbl_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op7_license_rules": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op8_toxic_crf": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op11_cross_tokens": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op12_pca_clusters": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op13_hyperminhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
}


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["The", "an", "réeux", "that", "über", "tion.", "a,"]) + str(r.randrange(40)) for _ in range(n))


def document_rows():
    base = words(1, 150)
    near = base.split()
    near[70] = "changed"
    mid = base.split()
    mid[10:50:10] = ["other"] * 4
    texts = [
        base, base, base.upper(), "  ".join(base.split()), " ".join(near), " ".join(mid), None, "", " \n\t", "one", "ONE", "two words", "words two", words(3, 6000),
        "x" * 3000, "licensed under CC-BY 4.0, the GNU General Public License", "<|endoftext|>'s  12  \x1c漢字é\n\n", "İstanbul \xa0 KK", "a\x00b", "ﬁne ① text",
        "a b c d e f g h i", "a b c d e f g h i j", "a b c d e f g h",
    ]
    out = [(k, t, "en" if k % 3 else None, "s" if k % 2 else None, None if t is None else len(t), 1, 2, "l", "r") for k, t in enumerate(texts)]
    return out + [out[0], out[4], (None, base, "en", "s", 3, None, 1, None, None), (None, None, None, None, None, None, None, None, None), (None, "alone here", None, None, 1, 1, 1, None, None)]


def vector_rows():
    r = np.random.default_rng(3)
    centre = r.normal(size=(20, 64))
    rows = [(k, (centre[k % 20] + r.normal(size=64) * 0.2).tolist()) for k in range(300)]
    bad = r.normal(size=64)
    return rows + rows[:3] + [
        (301, None), (302, [0.5] * 63), (303, [None] + [0.5] * 63), (304, [float("nan")] + [0.5] * 63), (305, [float("inf")] + [0.5] * 63),
        (306, [1e300] + [0.5] * 63), (307, [-2e6] + [0.0] * 63), (None, bad.tolist()), (7, bad.tolist()), (309, [-0.001] * 64),
    ]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """Awkward documents and embeddings next to the given other tables."""
    to = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame(document_rows(), DOCS).repartition(4).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(i, v, 1, 2) for i, v in vector_rows()], "vec_id long, embedding array<double>, v int, cluster int").repartition(3).write.parquet(f"{to}/embeddings.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{to}/{name}.parquet")
    return to


@pytest.fixture(scope="module")
def nothing(spark, sf, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("nothing"))
    for name in ("documents", "embeddings", "benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{to}/{name}.parquet")
    return to


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_contract(spark, folder, nothing, name):
    got = cut_lineage(catalog.QUERIES[name](spark, folder))
    if name in CONTRACT:
        want = [tuple(x.split()) for x in CONTRACT[name].split(", ")]
        assert got.dtypes[: len(want)] == want
        if name != "op12_pca_clusters":
            ids = collections.Counter(r[0] for r in document_rows())
            assert collections.Counter(r.doc_id for r in got.select("doc_id").collect()) == ids
    assert catalog.QUERIES[name](spark, nothing).count() == 0


def test_pipeline_of_nothing(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0


# --- alignment ----------------------------------------------------------------------


def tokens_of(text):
    """(id, bytes) of both vocabularies by the libraries, straight from their pieces."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(catalog.tokenizer_file())
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=catalog.tokenizer_file("piece_bpe_32k.model"))
    from fairline.llm.bpe import byte_letters

    letters = byte_letters()
    a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in second.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if text and b"".join(x[1] for x in a) == whole == b"".join(x[1] for x in b) else ([], [])


def spans(tokens):
    ends = list(itertools.accumulate(len(x[1]) for x in tokens))
    return [(i, e - len(x), e) for (i, x), e in zip(tokens, ends)]


def test_op11_brute_force(spark, folder):
    want, often, mine = [], collections.Counter(), []
    for row in document_rows():
        a, b = map(spans, tokens_of(row[1] or ""))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 3000 else sweep(a, b)
        often.update(links)
        mine.append(links)
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        inside = lambda side, lo, hi: ",".join(str(x[0]) for x in side if lo <= x[1] < hi)
        if len(cuts) < 500:
            groups = ";".join(f"{inside(a, lo, hi)}|{inside(b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
        else:
            groups = None
        want.append([row[0], len(a), len(b), len(cuts), len(links), groups])
    highest = collections.Counter()
    for (_, y), n in often.items():
        highest[y] = max(highest[y], n)
    got = catalog.op11_cross_tokens(spark, folder).collect()
    keyed = collections.Counter()
    for w, links in zip(want, mine):
        digest = None if w[5] is None else hashlib.sha256(w[5].encode()).hexdigest() if w[5] else ""
        keyed[(*w[:5], sum(often[p] == highest[p[1]] for p in links), sum(often[p] for p in links), digest)] += 1
    known = {x[-1] for x in keyed}
    assert collections.Counter((*r[:7], r[7] if r[7] in known else None) for r in got) == keyed


def sweep(a, b):
    out, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((i, b[k][0]))
            k += 1
    return out


def test_op11_outputs_in_small_blocks(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    files = catalog.tokenizer_file(), catalog.tokenizer_file("piece_bpe_32k.model")
    for r in align.alignments(docs, *files).collect():
        sides = [g.split("|") for g in r.groups.split(";")] if r.groups else []
        assert [int(x) for s in sides for x in s[0].split(",")] == r.ids_a
        assert [int(x) for s in sides for x in s[1].split(",")] == r.ids_b
        assert len(r.group_ends) == len(sides) and sorted(set(r.group_ends)) == r.group_ends
    want = sorted(map(str, align.summaries(docs, *files).collect()))
    # blocks of a text each give the same counts as one block of all
    one = sorted(map(str, align.summaries(docs.repartition(200, "doc_id", "text"), *files).collect()))
    assert want == one
    some = np.array([0, 5, 255, 256, 70_000, 1 << 30])
    assert all((align.unpack(align.pack(some[:n]), n) == some[:n]).all() for n in range(1, 7)) and align.pack(some[:0]) == b""


def test_op11_long_runs(spark):
    """Runs and characters that the two encoders of the first vocabulary may cut apart go to the library."""
    aligner = align.loaded(catalog.tokenizer_file(), catalog.tokenizer_file("piece_bpe_32k.model"))
    for text in ["ab" * 5000, " " * 3000 + "x", "é's Ǆ'll ɏ", "漢'st 漢's", "<|endoftext|>", words(5, 50)]:
        assert aligner.ids_a(text).tolist() == aligner.exact.encode(text, add_special_tokens=False).ids


# --- clusters -----------------------------------------------------------------------


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) <= 2**21 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j])] if members[j] else c for j, c in enumerate(centroids)]
    return [(i, *near(v)[::-1]) for i, v in kept], centroids


@pytest.mark.parametrize("take", [slice(None), slice(0, 5), slice(0, 1)])
def test_op12_brute_force(spark, take):
    rows = vector_rows()[take]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assigned, centroids = pca_clusters.clusters(pca_clusters.integer_vectors(table))
    want, want_centroids = brute_clusters(rows)
    assert centroids.tolist() == want_centroids
    got = pca_clusters.with_inertia(assigned, centroids).collect()
    beyond = [r for r in got if r.cluster is None]
    assert collections.Counter((r.vec_id, r.cluster, r.distance) for r in got if r.cluster is not None) == collections.Counter(want)
    assert {r.vec_id for r in beyond} == ({306} if take == slice(None) else set())
    per = collections.Counter()
    for _, c, d in want:
        per[c] += d
    assert all((r.cluster_inertia, r.inertia) == (per[r.cluster], sum(per.values())) for r in got if r.cluster is not None)


def test_op12_bounds_hold_and_prune():
    r = np.random.default_rng(1)
    centre = r.normal(size=(16, 64)) * 60
    v = np.floor(centre[r.integers(16, size=2000)] + r.normal(size=(2000, 64)) * 10).astype(np.int64)
    axes = np.linalg.svd(v - v.mean(0), full_matrices=True)[2].T
    rotation = pca_clusters.Rotation(v.mean(0), axes)
    centroids = np.floor(centre).astype(np.int64)
    best, distance, looked = pca_clusters.nearest(v, *rotation(v), centroids, rotation)
    every = ((v[:, None] - centroids[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert looked < 2000 * 3  # of sixteen distances per vector


# --- HyperMinHash -------------------------------------------------------------------


def two_words(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return {" ".join(w[k : k + 2]) for k in range(max(len(w) - 1, 1))} if w else set()


def brute_components(rows, sets):
    lead = {}
    alone = list(range(len(rows)))

    def find(i):
        while alone[i] != i:
            i = alone[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            alone[find(j)] = find(i)
    for i, r in enumerate(rows):
        if r is not None:
            lead[find(i)] = min(lead.get(find(i), r), r)
    return [lead.get(find(i)) for i in range(len(rows))]


def test_op13_brute_force(spark, folder):
    rows = document_rows()
    sets = [two_words(r[1]) for r in rows]
    component = brute_components([r[0] for r in rows], sets)
    want = collections.Counter((r[0], len(s), c, r[0] == c) for r, s, c in zip(rows, sets, component))
    got = catalog.op13_hyperminhash(spark, folder).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert len({c for c in component if component.count(c) > 1}) > 2


def family(seed, copies, changes):
    """Texts near one text, some of them beyond the threshold of each other."""
    r, base, out = random.Random(seed), words(seed, 120).split(), []
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randrange(changes)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_op13_families_in_small_cells(spark, monkeypatch):
    """Large keys and components in cells and parts give the links of all pairs."""
    texts = family(1, 60, 16) + family(2, 60, 10) + [words(s, 5) for s in range(30)] + family(3, 20, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_components(list(range(len(texts))), [two_words(t) for t in texts])
    got = lambda: [r.component_id for r in hyperminhash.near_groups(docs).orderBy("doc_id").collect()]
    assert got() == want
    monkeypatch.setattr(hyperminhash.candidates, "__defaults__", (10,))
    monkeypatch.setattr(hyperminhash.verified, "__defaults__", (1500, 10))
    assert got() == want
    assert 5 < len(set(want)) < len(texts)


def test_op13_registers():
    r = np.random.default_rng(2)
    for n in (3, 40, 5000):
        a = [np.unique(r.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(40)]
        b = [np.unique(np.r_[x[: int(n * 0.9)], r.integers(0, 2**64, n - int(n * 0.9), dtype=np.uint64)]) for x in a]
        true = np.array([len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for x, y in zip(a, b)])
        agree = (hyperminhash.registers(a) == hyperminhash.registers(b)).sum(1)
        size = np.full(40, n)
        assert abs(hyperminhash.estimated(agree, size).mean() - true.mean()) < 0.1
        apart = (hyperminhash.registers(a)[:-1] == hyperminhash.registers(a)[1:]).sum(1)
        assert abs(hyperminhash.estimated(apart, size[1:])).mean() < 0.02
    # a register is the smallest hash of its bucket, by leading zeros and the bits behind the first one
    x = np.array([(3 << hyperminhash._KEY_BITS) | (1 << 40) | (5 << 32)], np.uint64)
    lead = hyperminhash._KEY_BITS - 41
    assert hyperminhash.registers([x])[0, 3] == (lead << 10) | ((((5 << 32) << (lead + 1)) % (1 << hyperminhash._KEY_BITS)) >> (hyperminhash._KEY_BITS - 10))
    assert hyperminhash.missed(0.8) < 1e-6


def test_op13_finds_pairs_at_the_threshold(spark):
    """Planted pairs at 0.80 to 0.85: all are found."""
    texts, want = [], 0
    for s in range(150):
        base = [f"w{s}x{k}" for k in range(100)]
        other = list(base)
        for k in range(0, 100, 20 if s % 2 else 25):
            other[k + 3] = "z"
        a, b = two_words(" ".join(base)), two_words(" ".join(other))
        want += 100 * len(a & b) >= 80 * len(a | b)
        texts += [" ".join(base), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert hyperminhash.near_groups(docs).filter(F.col("doc_id") != F.col("component_id")).count() == want > 70
