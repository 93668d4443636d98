"""Operators for training data against brute force, on a small table with all awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fairline.llm import bpe, decontaminate, exact_dedup, gray_index, lbl_lm, license_rules, simhash, slots, token_rollup, toxic_crf, weak_quality
from fairline.llm.catalog import tokenizer_file
from fairline.session import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row int, key string, shard string, s string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["The", "an", "onth", "réeux", "that", "ing", "über", "tion.", "a,"]) + str(r.randrange(40)) for _ in range(n))


def rows():
    base, item = prose(1, 120), prose(9, 40)
    near = base.split()
    near[60] = "changed"
    texts = [
        base, base, base.upper(), "  ".join(base.split()), " ".join(near), None, "", " \n\t", "one", "two words", prose(3, 5000), "x" * 3000,
        "Licensed under CC-BY 4.0, the GNU General Public License, version 3. All rights\nreserved.", "CC  by cc-BY", "<|endoftext|>'s  12  \x1c漢字é\n\n",
        prose(4, 30) + " " + item + " " + prose(5, 30), item, " ".join(item.split()[:38]), "İstanbul \xa0 KK",
    ]
    out = [(k, t, "en" if k % 3 else None, "s" if k % 2 else None, None if t is None else len(t), "f", k, "k", "z", "q") for k, t in enumerate(texts)]
    return out + [out[0], out[4], (None, base, "en", "s", 3, None, 1, None, None, None), (None, None, None, None, None, None, None, None, None, None)], item


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data[0], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_hash(text, n):
    import xxhash

    w = [x.decode() for x in (text or "").encode().lower().split()]
    runs = [" ".join(w[j : j + n]) for j in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    return [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]


def test_op1_rollup(spark, docs, data, empty):
    counted = token_rollup.count_tokens(docs, {"words": None, "bpe": tokenizer_file()}).cache()
    rollup = token_rollup.corpus_rollup(docs, {}, scratch_path(spark, "t"), counted, min_tokens=3)
    want = collections.defaultdict(lambda: [0, 0])
    for r in data[0]:
        n = len((r[1] or "").encode().split())
        if n >= 3:
            want[r[3], r[2]][0] += 1
            want[r[3], r[2]][1] += n
    got = {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in rollup.totals().filter("tokenizer = 'words'").collect()}
    assert got == dict(want)
    assert not rollup.commit("1-load", spark.createDataFrame([], "kind string, old struct<source:string,lang:string,tokenizer:string,tokens:long>, new struct<source:string,lang:string,tokenizer:string,tokens:long>"))
    rollup.compact(path := scratch_path(spark, "t"))
    assert spark.read.parquet(path).count() == rollup.totals().count()
    none = token_rollup.corpus_rollup(empty, {}, scratch_path(spark, "t"), token_rollup.count_tokens(empty, {"words": None}))
    assert none.totals().count() == 0


def test_op1_counts_all_documents(spark, docs, data):
    versions = {"words": None, "bpe": tokenizer_file()}
    rollup = token_rollup.corpus_rollup(docs, versions, path := scratch_path(spark, "t"), token_rollup.count_tokens(docs, versions).cache())
    count = {"words": lambda t: len(t.encode().split()), "bpe": bpe.loaded(tokenizer_file()).count}
    want = collections.defaultdict(lambda: [0, 0])
    for r, name in itertools.product(data[0], versions):
        want[r[3], r[2], name][0] += 1
        want[r[3], r[2], name][1] += count[name](r[1] or "")
    assert {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in rollup.totals().collect()} == dict(want)
    assert spark.read.parquet(f"{path}/batch=4-stray-out").filter("d_docs < 0").count() > 0


def test_op2_slots(spark, docs, data, empty):
    table = slots.slotted(docs, 64)
    weights, counts = slots.slot_weights(table, 64)
    even = slots.SlotMap.even(4, 64)
    new = even.rebalanced(weights)
    new.save(spark, path := scratch_path(spark, "t"))
    even.save(spark, path)
    assert slots.SlotMap.load(spark, path).shards == new.shards and slots.SlotMap.load(spark, path, 0).shards == even.shards
    got = slots.sharded(table, new, counts).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    want = sorted((len((t := (r[1] or "").encode())) + 16, zlib.crc32(t)) for r in data[0])
    assert sorted((r.size, r.text_crc32) for r in got) == want
    assert slots.sharded(slots.slotted(empty, 64), even, [0] * 64).count() == 0
    random.seed(5)
    w = [random.randrange(50, 150) for _ in range(4096)]
    placed = slots.SlotMap.even(40, 4096).rebalanced(w)
    loads = [sum(x for x, s in zip(w, placed.shards) if s == k) for k in range(40)]
    assert max(loads) - min(loads) <= 0.001 * sum(w) / 40
    grown = placed.rebalanced(w, 41)
    assert len(grown.moves) < 400 and set(grown.shards) == set(range(41))


def test_op3_bpe(docs, data, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file()
    theirs, mine = Tokenizer.from_file(path), bpe.loaded(path)
    r = random.Random(2)
    parts = ["a", "th", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "é", "1", "²", "'s", "'ll", "!", "&&", "漢", "😀", "ing", "<|endoftext|>", "zzzzzz", "　", "ß"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(30)))
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert list(mine.encode(t)) == ids and mine.count(t) == len(ids)
        assert mine.decode(np.array(ids)) == theirs.decode(ids, skip_special_tokens=False) == t
    assert mine.decode(np.array([mine.id_of[b"\xc3"]])) == "�"
    long = "ab" * 50_000
    assert list(mine.encode(long)) == theirs.encode(long, add_special_tokens=False).ids
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.digests(bpe.encode_documents(docs, path)).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d in data[0]:
        ids = theirs.encode(d[1] or "", add_special_tokens=False).ids
        want.append((d[0] if d[0] is not None else -1, len(ids), sha(",".join(map(str, ids))), sha(d[1] or "")))
    assert got == sorted(want)
    assert bpe.encode_documents(empty, path).count() == 0


@pytest.mark.parametrize("lanes, radius, flips", [(1, 4, 4), (8, 60, 40)])
def test_op4_index_keeps_components(lanes, radius, flips):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.integers(0, 2**63, (3, lanes), dtype=np.uint64), 150, 0)
    for _ in range(flips):
        k = rng.integers(0, 64 * lanes, len(x))
        x[np.arange(len(x)), k // 64] ^= np.uint64(1) << (k % 64).astype(np.uint64)
    x = np.concatenate([x, rng.integers(0, 2**63, (100, lanes), dtype=np.uint64)])
    group = np.sort(rng.integers(0, 3, len(x)))
    label = np.arange(len(x))
    for i, j in gray_index.bucket_links(group, x, radius):
        assert group[i] == group[j] and gray_index.distance(x[i], x[j]) <= radius
        label[label == label[j]] = label[i]
    near = (gray_index.distance(x[:, None], x[None]) <= radius) & (group[:, None] == group[None])
    assert (label[:, None] == label[None])[near].all()


def test_op4_gray_rank():
    codes = np.array([[k ^ (k >> 1)] for k in range(300)], np.uint64)
    assert gray_index.gray_rank(codes)[:, 0].tolist() == list(range(300))


@pytest.mark.parametrize("cell", [simhash.CELL, 3])
def test_op4_components(spark, docs, data, empty, monkeypatch, cell):
    monkeypatch.setattr(simhash.links, "__defaults__", (cell,))
    fp = {}
    for k, r in enumerate(data[0]):
        h = shingle_hash(r[1], 4)
        fp[k] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    ids = {k: r[0] for k, r in enumerate(data[0])}
    label = dict(ids)
    while True:
        new = {k: min((label[j] for j in fp if (fp[k] ^ fp[j]).bit_count() <= 4 and label[j] is not None), default=None) for k in fp}
        if new == label:
            break
        label = new
    got = simhash.near_groups(docs).select("doc_id", F.lower(F.hex("fp")).alias("f"), "component_id").collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(key, got)) == sorted(key((ids[k], f"{fp[k]:016x}", label[k])) for k in fp)
    assert simhash.near_groups(empty).count() == 0


def test_op4_stage_keeps_columns(docs, empty):
    left = simhash.drop_near_copies(docs)
    kept = {r.doc_id for r in left.collect()}
    assert left.columns == docs.columns and 0 in kept and not kept & {1, 3, 4} and 2 in kept and {8, 9, 10, 11} <= kept
    assert simhash.drop_near_copies(empty).count() == 0


def word_sets(texts):
    def one(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()

    return [one(t) for t in texts]


def joined(sets):
    """Label of each set: components of pairs at 0.8 or more."""
    label = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
            label = [label[i] if x == label[j] else x for x in label]
    return label


def shared_texts():
    """Families at similarities around 0.8, texts that share a passage many times, and empty ones."""
    r, texts = random.Random(8), []
    for k in range(40):
        base = [f"w{k}x{i}" for i in range(204)]
        at = r.randrange(14, 34)  # changed words at the end: at 23 of 200 shingles the pair is just at 0.8
        texts += [" ".join(base), " ".join(base[: 204 - at] + [f"c{k}y{i}" for i in range(at)])]
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [" ".join([passage] * 60 + [f"own{k}z{i}" for i in range(60)]) for k in range(3)]
    return texts + ["", " ", "one", "one", "two words"]


@pytest.mark.parametrize("few", [simhash.FEW, 0])
def test_op4_sets_are_compared_exactly(monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    r = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    texts = [*shared_texts()]
    for _ in range(60):
        w = words[:]
        for i in r.sample(range(60), 2):
            w[i] = f"v{r.randrange(6)}"
        texts.append(" ".join(w))
    r.shuffle(texts)
    label = list(range(len(texts)))
    for i, j in simhash.set_links([simhash.shingles(t, simhash.FIVE_WORDS) for t in texts]):
        assert label[i] != label[j]
        label = [label[i] if x == label[j] else x for x in label]
    want = joined(word_sets(texts))
    assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


@pytest.mark.parametrize("cell", [simhash.SET_CELL, 1])
def test_op4_stage_keeps_what_is_under_the_threshold(spark, monkeypatch, cell):
    assert simhash.FIVE_WORDS.recall(0.8) > 0.999 and simhash.FIVE_WORDS.accepted(0.8) > 0.9999
    monkeypatch.setattr(simhash.verified_groups, "__defaults__", (simhash.FIVE_WORDS, cell))
    texts = shared_texts()
    label = joined(word_sets(texts))
    left = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {label.index(x) for x in label}


def test_op5_scores(docs, data, empty):
    got = lbl_lm.score_documents(docs, classes=16, head=30).collect()
    words = lambda t: (t or "").encode().lower().split() + [b""]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = collections.Counter(w for r in data[0] if not out(r[0]) for w in words(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((r[0] or 0, out(r[0]), len(w := words(r[1])), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)) for r in data[0])
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lbl_lm.score_documents(empty).count() == 0


def test_op5_head_words(spark):
    """The cut takes all words above a count and a bounded part of those tied at it."""
    r = random.Random(3)
    words = {f"w{k}": c for k, c in enumerate([*(r.randrange(1, 2000) for _ in range(900)), *[1] * 4000, *[7] * 300, 1 << 40])}
    df = spark.createDataFrame(list(words.items()), "word string, c long")
    by_count = collections.Counter(words.values())
    for head in (0, 1, 40, 700, 1150, 2000, 6000):
        got = {x.word: x.c for x in lbl_lm.head_words(df, head).collect()}
        assert len(got) <= head and all(words[w] == c for w, c in got.items())
        above, cut = 0, None
        for c in sorted(by_count, reverse=True):
            if above + by_count[c] > head:
                cut = c
                break
            above += by_count[c]
        full = {w for w, c in words.items() if cut is None or c > cut}
        assert full <= set(got) and all(c == cut for w, c in got.items() if w not in full)
        if head >= 700:  # ties fill most of what is left
            assert len(got) >= 0.85 * min(head, len(words))
    assert lbl_lm.head_words(df.filter("false"), 5).count() == 0


def test_op5_probabilities_sum_to_one():
    unigram = np.array([5.0, 3, 2, 1, 1]) / 12
    trainer = lbl_lm.Trainer(lbl_lm.Model.start(unigram, 4), unigram)
    seq = np.array([2, 3, 4] * 3000)
    far, near = lbl_lm.contexts(seq)
    for _ in range(60):
        trainer.step(far, near, seq)
    m = trainer.m
    z = m.normalisers(np.arange(5))
    for a, b in itertools.product(range(5), repeat=2):
        p = np.exp(m.log_probabilities(z, np.full(5, a), np.full(5, b), np.arange(5)))
        assert abs(p.sum() - 1) < 1e-4
    assert np.exp(m.log_probabilities(z, np.array([2]), np.array([3]), np.array([4])))[0] > 0.5


def test_op6_leaks(spark, docs, data, empty):
    items = [(1, data[1], "x"), (2, prose(77, 30), "x"), (3, None, "x"), (4, "too short", "x"), (5, data[1], "y")]
    bench = spark.createDataFrame(items, "item_id int, text string, s string")

    def shingles(t):
        w = (t or "").lower().split()
        return [tuple(w[j : j + 5]) for j in range(len(w) - 4)]

    want = {}
    for r, i in itertools.product(data[0], items):
        mine, theirs = shingles(r[1]), shingles(i[1])
        if mine and theirs:
            m, best = len(theirs), 0
            for s in range(max(1, len(mine) - m + 1)):
                a, b = collections.Counter(mine[s : s + m]), collections.Counter(theirs)
                both = (a & b).total()
                best = max(best, both / (a.total() + b.total() - both))
            if best >= 0.8:
                want[r[0], i[0]] = round(best, 9)
    assert {k[0] for k in want} == {15, 16, 17}
    got = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want and len(got) == len(want)
    left = decontaminate.drop_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 3
    nameless = docs.filter("doc_id = 15").withColumn("doc_id", F.lit(None).cast("long"))
    found = decontaminate.leaks(nameless, bench).collect()
    assert {r.item_id for r in found} == {k[1] for k in want if k[0] == 15} and decontaminate.drop_leaks(nameless, bench).count() == 0
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_op7_base_phrases(docs, data, empty):
    got = collections.Counter()
    for r in license_rules.scan(docs.select("doc_id", "text", "key")).collect():
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        got[r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels] += 1
    want = collections.Counter()
    for d in data[0]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in d[1] or ""))
        at = [(k, label) for label, p in license_rules.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[d[0], len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x[1] for x in at}))] += 1
    assert got == want
    assert license_rules.scan(empty.select("doc_id", "text")).count() == 0


def test_op7_rules(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Released under the MIT License.": "mit",
        "SPDX-License-Identifier: MPL-2.0": "mpl-2.0",
        "mit der Zeit": "",
        "Apache tribes": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    assert {r.text: r.labels for r in df.join(license_rules.scan(df), "doc_id").collect()} == cases
    assert len(license_rules.rules()) > 300


def test_op8_marginals():
    rng = np.random.default_rng(1)
    emissions, moves, start = [rng.normal(size=n) for n in (4, 1, 0, 3)], rng.normal(size=(2, 2)), 0.3
    pairs, want_pairs = np.zeros((2, 2)), np.zeros((2, 2))
    got = toxic_crf.marginals(emissions, start, moves, pairs)
    for e, p in zip(emissions, got):
        if not len(e):
            continue
        total, on = 0.0, np.zeros(len(e))
        trans = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(e)):
            w = math.exp(start * y[0] + sum(e[k] for k in range(len(e)) if y[k]) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total, on = total + w, on + w * np.array(y)
            for a, b in zip(y, y[1:]):
                trans[a, b] += w
        assert np.allclose(p, on / total)
        want_pairs += trans / total
    assert np.allclose(pairs, want_pairs)


def test_op8_learns_and_keeps_columns(spark, docs, empty):
    r = random.Random(4)
    texts, toxic = [], []
    for k in range(300):
        w = [r.choice(["red", "green", "blue", "tree", "house", "sky"]) for _ in range(40)]
        toxic.append(int(k % 4 == 0))
        if toxic[-1]:
            for at in r.sample(range(40), 3):
                w[at] = r.choice(["moron!", "scum"])
        texts.append(" ".join(w))
    model = toxic_crf.fit(texts, toxic, {0: 225.0, 1: 75.0})
    got = [model.score(p) >= 0.5 for p in model.tag(texts)]
    assert got == [bool(t) for t in toxic]
    text = "a Moron! is here"
    assert [text[s["start"] : s["end"]] for s in model.spans(text, model.tag([text])[0])] == ["Moron!"]
    out = toxic_crf.tagged(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= x.score <= 1 for x in out)
    left = toxic_crf.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == docs.count()
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(19)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert toxic_crf.tagged(empty, toxic_crf.train(docs, labels)).count() == 0
    assert toxic_crf.tagged(docs, toxic_crf.train(docs, labels.limit(0))).count() == docs.count()


def test_op9_groups(spark, docs, data, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for r in data[0]:
        groups[norm(r[1])].append(r[0])
    for k in (1024, 1):  # by shuffle, and with heavy digests broadcast
        got = exact_dedup.exact_groups(docs, k).collect()
        key = lambda x: tuple(-1 if v is None else v for v in x)
        want = [(r[0], min((i for i in groups[norm(r[1])] if i is not None), default=None), len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in data[0]]
        assert sorted(key((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == sorted(map(key, want))
        kept = [r for r in got if r.kept]
        assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
        left = exact_dedup.drop_exact_copies(docs, k)
        assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


def test_op9_misra_gries_names_frequent_values(spark):
    values = ["hot"] * 400 + [f"v{k % 300}" for k in range(600)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "d string").repartition(7)
    assert "hot" in {r.d for r in exact_dedup.misra_gries(df, "d", 4).collect()}


def test_op10_quality(spark, docs, empty):
    good = [" ".join(prose(k, 12) + "." for _ in range(8)) for k in range(60)]
    low = [" ".join(w.upper() + "!!" for w in prose(k, 90).split()) for k in range(20)]
    table = spark.createDataFrame(list(enumerate(good + low)), "doc_id int, text string")
    model = weak_quality.train(table)
    got = {r.doc_id: r.score for r in weak_quality.scored(table, model).collect()}
    assert min(got[k] for k in range(60)) > 0.5 > max(got[k] for k in range(60, 80))
    assert np.allclose(model.rates.sum(2), 1)
    out = weak_quality.scored(docs, weak_quality.train(docs)).collect()
    assert len(out) == docs.count() and all(0 < r.score < 1 for r in out)
    assert weak_quality.scored(empty, weak_quality.train(empty)).count() == 0


def test_pipeline(spark, sf, tmp_path):
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0 and sizes[-2] == sizes[-1]
