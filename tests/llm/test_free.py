import collections
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netquarry.llm import classifier, components, decontamination, line_dedup, near_dedup, packing, quality_rules, sharding, token_counts, tokens
from netquarry.llm.queries import tokenizer_file

from . import fixtures

JSON, RANKS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def key(t):
    return tuple((x is not None, x) for x in t)


# near duplicates


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_rows(rows):
    """(n_shingles, component_id, kept) of each row (doc_id, text): rows are told apart by id and set."""
    sets = [shingles(t) for _, t in rows]
    parent = {s: s for s in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = collections.defaultdict(list)
    for s in parent:
        for x in s:
            by[x].append(s)
    for v in by.values():
        for i, a in enumerate(v):
            for b in v[i + 1 :]:
                common = len(a & b)
                if 100 * common >= 75 * (len(a) + len(b) - common):
                    parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for (d, _), s in zip(rows, sets):
        if s and d is not None:
            least[find(s)].append(d)
    out = []
    for (d, _), s in zip(rows, sets):
        component = min(least[find(s)], default=None) if s else d
        out.append((len(s), None if d is None else component, component == d if d is not None else component is None))
    return out


def brute_classes(rows):
    return {d: r for (d, _), r in zip(rows, brute_rows(rows), strict=True)}


def check_classes(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = collections.Counter(tuple(r) for r in near_dedup.near_duplicates(docs).collect())
    want = collections.Counter((d, *r) for (d, _), r in zip(rows, brute_rows(rows), strict=True))
    for c in (got, want):
        for k in [k for k in c if k[0] is None]:
            # Of null ids in a class of their own only the node that stands for it is kept; the rest is compared.
            c[(*k[:3], None)] += c.pop(k)
    assert got == want


def test_near_duplicates_that_share_an_id(spark):
    """Different texts under one doc_id, near copies of each; words that polynomial hashes confuse; null ids."""
    a, b = [[f"{c}{i}" for i in range(60)] for c in "ab"]
    near = lambda w, k: " ".join([*w[:k], "changed", *w[k + 1 :]])
    thue = "a"
    while len(thue) < 2048:
        thue += thue.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 1)), (3, near(b, 1)), (4, near(b, 58)), (5, thue), (6, thue.translate(str.maketrans("ab", "ba")))]
    rows += [(None, near(a, 59)), (None, "null words only here with no id"), (None, "null words only here with no id"), (7, " ".join(a)), (7, " ".join(a))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 7, "r") for i, t in rows], fixtures.DOC_SCHEMA)
    check_classes(docs)
    kept = sorted(key((r["doc_id"], r["text"])) for r in near_dedup.keep_one_of_each(docs).select("doc_id", "text").collect())
    assert kept == sorted(map(key, [rows[0], rows[1], rows[5], rows[6], rows[8]]))


def test_near_duplicates(spark, sf_dir):
    check_classes(fixtures.awkward(spark))
    check_classes(documents(spark, sf_dir))
    assert near_dedup.near_duplicates(fixtures.empty(spark)).count() == 0


def test_near_duplicates_in_long_lists(spark):
    """A large group of edited copies, and documents that share only a passage: lists far over COLD."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(120), rng.randint(0, 4)):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    for i in range(150, 300):
        rows.append((i, " ".join([*passage, *[f"q{i}_{k}" for k in range(rng.randint(5, 60))]])))
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 7, "r") for i, t in rows], fixtures.DOC_SCHEMA)
    check_classes(docs)


def test_keep_one(spark):
    docs = fixtures.awkward(spark)
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(key((r["doc_id"],)) for r in kept.collect())
    assert ids == sorted(key((i,)) for i in [1, 2, 3, 4, 7, 9, 10, 11, 12, 13, 14, 15, None, None])
    assert near_dedup.keep_one_of_each(fixtures.empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or find(x) != x or x in got}


# sharding


def check_shards(docs):
    got = sharding.shard_by_bytes(docs).collect()
    rows = [(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(key, rows)) == sorted(key(tuple(r)[:3]) for r in got)
    total, largest = sum(r[1] for r in rows), max((r[1] for r in rows), default=0)
    by = collections.defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        by[r["shard"]].append(r)
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
        assert abs(sum(r["size"] for r in v) - total / 8) <= largest
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [key(tuple(r)[:3]) for r in ordered] == sorted(map(key, rows))


def test_shards(spark, sf_dir):
    check_shards(fixtures.awkward(spark))
    check_shards(documents(spark, sf_dir))
    check_shards(fixtures.empty(spark))


# packing


def check_packing(docs, fill):
    got = packing.pack(docs, JSON, RANKS).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r["length"] for r in got) // 2048)
    assert len(by) <= fill(least)


def test_packing(spark, sf_dir):
    check_packing(fixtures.awkward(spark), lambda n: n + 1)
    check_packing(documents(spark, sf_dir), lambda n: n + 2)
    assert packing.pack(fixtures.empty(spark), JSON, RANKS).count() == 0


def test_special_strings_in_texts(spark):
    """By the plain call of the tokenizer a special string is its token, in simple texts and others."""
    encode = tokens.byte_bpe(JSON, RANKS)
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]
    assert 50256 in encode("中 <|endoftext|> b")
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 7, "r") for i, t in enumerate(["a <|endoftext|> b", "<|endoftext|>" * 3000, "中<|endoftext|>", None])], fixtures.DOC_SCHEMA)
    check_packing(docs, lambda n: n + 2)


def test_packed_sequences(spark):
    docs = fixtures.awkward(spark)
    pieces = packing.pack(docs, JSON, RANKS)
    got = packing.packed_sequences(pieces).collect()
    encode = tokens.byte_bpe(JSON, RANKS)
    assert sum(len(r["ids"]) for r in got) == sum(len(encode(t or "")) + 1 for _, t in fixtures.AWKWARD)
    assert all(len(r["ids"]) == sum(r["lengths"]) <= 2048 for r in got)
    back = collections.defaultdict(dict)
    for r in pieces.collect():
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        back[r["doc_id"]][r["piece"]] = r["ids"]
    assert [x for k in sorted(back[7]) for x in back[7][k]] == [*encode(fixtures.LONG), 0]


def test_shards_carry_texts(spark):
    got = sharding.shard_by_bytes(fixtures.awkward(spark), carry=("text", "n")).collect()
    assert sorted(map(key, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(key, fixtures.AWKWARD)) and {r["n"] for r in got} == {7}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_fullest_is_a_largest_subset_sum(counts, slack):
    sums = {0}
    for length, n in counts.items():
        for _ in range(n):
            sums |= {s + length for s in sums if s + length <= slack}
    chosen = packing.fullest(slack, counts)
    assert sum(chosen) == max(sums)
    assert all(n <= counts[k] for k, n in collections.Counter(chosen).items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 99), st.integers(1, 30), max_size=20))
def test_bins_use_up_the_histogram(histogram):
    bins = packing.fill_bins(histogram, 100)
    used = collections.Counter()
    for lengths, times in bins:
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] += times
    assert used == histogram


# token counts


def greedy(word, initial, continuing):
    n, at, pieces = 0, 0, initial
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        n, at, pieces = n + 1, end, continuing
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=15), st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=15), st.binary(max_size=14).map(lambda b: bytes(97 + x % 3 for x in b)))
def test_longest_match_is_greedy(initial, continuing, word):
    assert tokens.LongestMatch(initial, continuing).count(word) == greedy(word, initial, continuing)


def check_counts(docs):
    _, initial, continuing = tokens.word_pieces(RANKS)
    known = {}

    def count(w):
        if w not in known:
            known[w] = greedy(w, initial, continuing) if len(w) < 500 else tokens.word_pieces(RANKS)[0].count(w)
        return known[w]

    want = []
    for r in docs.select("doc_id", "text").collect():
        c = [count(w.encode()) for w in WORD.findall(r["text"] or "")]
        want.append((r["doc_id"], len(c), sum(c), max(c, default=0)))
    assert sorted(map(key, want)) == sorted(key(tuple(r)) for r in token_counts.count_tokens(docs, RANKS).collect())


def test_token_counts(spark, sf_dir):
    check_counts(fixtures.awkward(spark))
    check_counts(documents(spark, sf_dir))
    assert token_counts.count_tokens(fixtures.empty(spark), RANKS).count() == 0


# classifier


def test_classifier(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = classifier.train(classifier.sample(docs, labels))
    scored = classifier.score_documents(docs, net)
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    out = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert len(out) > 500 and np.mean([p == q for p, q in out]) > 0.95
    assert np.mean([p == 1 for p, q in out if q == 1]) > 0.97
    awkward = classifier.score_documents(fixtures.awkward(spark), net)
    assert awkward.count() == len(fixtures.AWKWARD)
    kept = classifier.keep_good(docs, net)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r["predicted"]}
    assert classifier.keep_good(fixtures.empty(spark), net).count() == 0


def test_classifier_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = classifier.train(classifier.sample(fixtures.awkward(spark), labels))
    assert {r["score"] for r in classifier.score_documents(fixtures.awkward(spark), net).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert classifier.sample(fixtures.awkward(spark), labels) == []


def brute_score(net, raw):
    """The forward pass, position by position and chunk by chunk."""
    raw = list(raw) + [0] * max(0, classifier.WIDTH - len(raw))
    while (len(raw) - classifier.WIDTH) % classifier.STRIDE:
        raw.append(0)
    r = []
    for a in range(0, len(raw) - classifier.WIDTH + 1, classifier.STRIDE):
        patch = np.concatenate([net.w["embed"][x] for x in raw[a : a + classifier.WIDTH]])
        r.append(np.maximum(patch @ net.w["filter"] + net.w["bias"], 0))
    tops, a = [], 0
    while True:
        tops.append(np.max(r[a : a + classifier.CHUNK], axis=0))
        if a + classifier.CHUNK >= len(r):
            break
        a += classifier.STEP
    z = np.concatenate([np.mean(tops, axis=0), np.max(tops, axis=0)]) @ net.w["out"] + net.w["shift"][0]
    return 1 / (1 + np.exp(-z))


def test_scores_are_those_of_the_plain_network():
    net, rng = classifier.ByteNetwork.fresh(), np.random.default_rng(3)
    net.w["out"] *= 20
    for n in (0, 1, 5, 6, 7, 8, 9, 11, 325, 326, 327, 501, 1999, 2000, 7001):
        raw = rng.integers(0, 256, n).astype(np.uint8)
        assert abs(net.score(raw) - brute_score(net, raw)) < 1e-5, n
        if n:
            scores = {round(net.score(np.append(raw[:-1], np.uint8(x))), 9) for x in range(0, 256, 5)}
            assert len(scores) > 1 or n > 400


def test_sample_reaches_its_bound(spark):
    """Labels without a document take no room, and long texts are learnt from."""
    docs = spark.createDataFrame([(i, "x" * (50_000 if i % 2 else 10)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0, 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    got = classifier.sample(docs, labels, {0: 100, 1: 50})
    assert [sum(y == k for _, y in got) for k in (0, 1)] == [100, 50] and any(len(t) == classifier.LEARNT for t, _ in got)


def test_one_long_text_leaves_the_sample_whole(spark):
    """A labelled text longer than any bound is learnt from in spans from its first byte to its last; all other rows stay."""
    longest = "a" * 400 + "x" * 30_000_000 + "z" * 400
    learnt = next(i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2)
    docs = spark.createDataFrame([(i, longest if i == learnt else f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = classifier.sample(docs, labels, {0: 1000, 1: 1000})
    assert len(got) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(300))
    (spans,) = [t for t, _ in got if len(t) > 100]
    assert len(spans) == classifier.LEARNT and spans[:400] == b"a" * 400 and spans[-400:] == b"z" * 400 and spans[512:-512] == b"x" * (classifier.LEARNT - 1024)


def test_columns_that_clash(spark):
    """Extra columns named like those that the operators use inside pass unchanged."""
    names = ["_score", "_leaked_items", "_doc", "_h1", "doc", "kept", "copy", "rows"]
    docs = spark.createDataFrame([(1, "some good words of a text", *names), (2, "one two three four five six seven eight nine ten", *names)], ["doc_id", "text", *names])
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    net = classifier.ByteNetwork.fresh()
    net.w["shift"][0] = 50
    assert sorted(map(tuple, classifier.keep_good(docs, net).collect())) == sorted(map(tuple, docs.collect()))
    for left in (decontamination.drop_contaminated(docs, bench), line_dedup.dedup_lines(docs).select(*docs.columns), near_dedup.keep_one_of_each(docs)):
        assert left.columns == docs.columns and tuple(docs.first()) in set(map(tuple, left.collect()))
    assert [r["doc_id"] for r in decontamination.drop_contaminated(docs, bench).collect()] == [1]
    docs = docs.withColumn("source", F.lit("host"))
    cleaned = quality_rules.cleaned_documents(docs)
    assert cleaned.columns == [*[c for c in docs.columns if c != "kept"], "kept"]


def test_nothing_learnt_rejects_nothing(spark):
    docs = fixtures.awkward(spark)
    with pytest.warns(UserWarning, match="every document is kept"):
        assert classifier.keep_good(docs, 0.5).count() == docs.count()


def test_gradients_are_right():
    net = classifier.ByteNetwork.fresh()
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    net.w["out"] *= 10
    rng = np.random.default_rng(1)
    texts = [rng.integers(32, 127, n).astype(np.uint8) for n in (900, 3, 401)]
    loss = lambda: sum(w * -np.log(net.score(t) if y else 1 - net.score(t)) for t, y, w in zip(texts, (1, 0, 1), (1, 0.5, 2)))
    g = net.gradients(texts, [1, 0, 1], [1, 0.5, 2])
    for k, at in (("shift", 0), ("out", 3), ("out", 20), ("filter", (5, 2)), ("bias", 4), ("embed", (int(texts[0][10]), 1)), ("embed", (0, 2))):
        net.w[k][at] += 1e-5
        up = loss()
        net.w[k][at] -= 2e-5
        down = loss()
        net.w[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-3


# decontamination


def test_common_subsequences():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(1, n))] for n in (rng.choice([20, 64, 65, 200]), 90))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = np.zeros((1, len(b), -(-len(a) // 64)), np.uint64)
        for j, y in enumerate(b):
            for i, x in enumerate(a):
                if x == y:
                    masks[0, j, i // 64] |= np.uint64(1 << i % 64)
        assert decontamination.common_subsequences(masks, np.array([len(a)]))[0] == table[-1][-1]


def test_singular_vectors_are_those_of_the_matrix():
    """The randomised decomposition against the plain one of the same weighted matrix."""
    rng = np.random.default_rng(4)
    topics = rng.random((12, 300)) ** 8
    texts = [" ".join(f"w{k}" for k in rng.choice(300, 15, p=topics[i % 12] / topics[i % 12].sum())) for i in range(400)]
    raw, offsets = next((x[2], x[3]) for x in decontamination.chunks(decontamination.pa.array(texts)))
    p = decontamination.Passages(raw, offsets)
    frequency = np.bincount(decontamination._firsts(p), minlength=decontamination.TERMS)
    idf = decontamination._weights(frequency, len(p.block_start))[:, None]
    product = np.zeros(decontamination.TERMS * decontamination.WIDTH, np.float32)
    decontamination._add_sketch(p, product)
    basis = decontamination._orthonormal(product.reshape(decontamination.TERMS, -1) * idf)
    b = p.windows(decontamination._with_zeros(basis * idf)).astype(np.float64)
    _, values = decontamination._singular(basis, b.T @ b)
    terms = np.flatnonzero(frequency)
    dense = np.zeros((len(terms) + 1, len(terms)), np.float32)
    dense[np.arange(len(terms)), np.arange(len(terms))] = idf[terms, 0]
    table = np.zeros((decontamination.TERMS + 1, len(terms)), np.float32)
    table[terms] = dense[:-1]
    exact = np.linalg.svd(p.windows(table).T, compute_uv=False)
    assert np.all(np.abs(values[:12] - exact[:12]) <= 0.1 * exact[:12])


def planted(spark, sf_dir, seed=4):
    """Documents with items put in, whole and with every sixth word replaced."""
    rng = random.Random(seed)
    docs = [tuple(r) for r in documents(spark, sf_dir).orderBy("doc_id").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows, want = [], {}
    for i, (d, t) in enumerate(docs):
        rows.append((d, t))
        if i % 4 == 0:
            item, text = rng.choice(items)
            w = text.split()
            if i % 8 == 0:
                w = [f"other{i}x{k}" if k % 6 == 5 else x for k, x in enumerate(w)]
            words = (t or "").split(" ")
            at = rng.randint(0, len(words))
            rows.append((100_000 + d, " ".join([*words[:at], *w, *words[at:]])))
            want[100_000 + d] = item
    return spark.createDataFrame(rows, "doc_id long, text string"), want


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_decontamination(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs, want = planted(spark, sf)
    got = {r["doc_id"]: r["item_ids"].split(",") for r in decontamination.contaminated_documents(docs, bench).collect()}
    missed = [d for d, i in want.items() if str(i) not in got[d]]
    assert len(missed) <= 0.004 * len(want), (len(missed), len(want))
    clean = {r["doc_id"]: r["text"].split() for r in documents(spark, sf).collect()}
    items = {r["item_id"]: r["text"].split() for r in bench.collect()}
    grams = collections.defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 3):
            grams[tuple(w[k : k + 4])].add(i)
    whole = {d: {str(i) for i, n in collections.Counter(i for k in range(len(w) - 3) for i in grams.get(tuple(w[k : k + 4]), ())).items() if n >= 0.5 * (len(items[i]) - 3)} for d, w in clean.items()}
    assert sum(map(bool, whole.values())) >= 20
    for d, w in whole.items():
        assert w == {x for x in got[d] if x}, d


def test_decontamination_edges(spark):
    none = spark.createDataFrame([(1, None), (None, "a b c"), (2, "")], "item_id long, text string")
    bench = spark.createDataFrame([(5, fixtures.PASSAGE), (6, fixtures.PASSAGE)], "item_id long, text string")
    docs = fixtures.awkward(spark)
    assert decontamination.drop_contaminated(docs, none).count() == len(fixtures.AWKWARD)
    assert decontamination.contaminated_documents(fixtures.empty(spark), bench).count() == 0
    dropped = decontamination.drop_contaminated(docs, bench)
    assert dropped.columns == docs.columns
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in dropped.collect()} == {9, 10, 11}


@pytest.mark.parametrize("unlike", [False, True])
def test_decontamination_of_an_item_in_a_third_of_the_rows(spark, unlike):
    """Whole and edited leaks of one item in every third row, as copies of one document or each in a document of its own."""
    rng = random.Random(9)
    docs = [tuple(r) for r in documents(spark, "/root/testdata/sf0.001").orderBy("doc_id").select("doc_id", "text").collect()]
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    before = {r["doc_id"]: r["item_ids"] for r in decontamination.contaminated_documents(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    for item in bench.orderBy("item_id").limit(3).collect():
        rows, leaks = list(docs), set()
        for i in range(len(docs) // 2):
            w = [f"other{i}x{k}" if i % 2 and k % 6 == 5 else x for k, x in enumerate(item["text"].split())]
            around = [(rng.choice(docs)[1] or "").split()[:20] if unlike else ["one", "text", "before"] for _ in range(2)]
            rows.append((500_000 + i, " ".join([*around[0], *w, *around[1]])))
            leaks.add(500_000 + i)
        got = {r["doc_id"]: r["item_ids"] for r in decontamination.contaminated_documents(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
        assert all(str(item["item_id"]) in got[d].split(",") for d in leaks)
        assert all(set(x.split(",")) <= {*got[d].split(","), ""} for d, x in before.items())


@pytest.mark.parametrize("leaks,others", [(1, 0), (3, 0), (4, 3), (4, 50), (40, 400), (100, 5), (1000, 100)])
def test_decontamination_of_few_documents(spark, leaks, others):
    rng = random.Random(leaks + others)
    item = "which river flows through the old town of the seven bridges and the mill. the green river"
    bench = spark.createDataFrame([(1, item), (2, "a wholly different question about copper wire prices. nine coins")], "item_id long, text string")
    rows = [(i, f"note {i} {item} end {i}") for i in range(leaks)] + [(5000 + j, f"other text {j} " + " ".join(f"w{j}x{k}" for k in range(rng.randint(5, 60)))) for j in range(others)]
    got = decontamination.contaminated_documents(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted(tuple(r) for r in got) == [(i, True, 1, "1") for i in range(leaks)] + [(5000 + j, False, 0, "") for j in range(others)]


@pytest.mark.parametrize("copies", [1, 200, 10_000])
def test_decontamination_of_an_item_that_leaks_often(spark, copies):
    rng = random.Random(copies)
    docs = [tuple(r) for r in documents(spark, "/root/testdata/sf0.01").orderBy("doc_id").select("doc_id", "text").collect()]
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id")
    for item in bench.limit(5).collect()[:: 4 if copies > 1000 else 1]:
        rows = [*docs, *[(500_000 + i, " ".join([*(rng.choice(docs)[1] or "").split()[:40], item["text"], *(rng.choice(docs)[1] or "").split()[:40]])) for i in range(copies)]]
        got = {r["doc_id"]: r["item_ids"].split(",") for r in decontamination.contaminated_documents(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
        assert all(str(item["item_id"]) in got[500_000 + i] for i in range(copies))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_decontamination_recall_on_paraphrases(spark, sf):
    """Every n-th word replaced, from a phase of its own: at least 0.9 is found for each n; measured 0.99 and more."""
    rng = random.Random(7)
    docs = [tuple(r) for r in documents(spark, sf).orderBy("doc_id").select("doc_id", "text").collect()]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [tuple(r) for r in bench.orderBy("item_id").collect()]
    rows, want = list(docs), {}
    for n in (3, 4, 5, 6):
        for j in range(100):
            item, text = rng.choice(items)
            o = rng.randrange(n)
            w = [f"new{n}x{j}x{k}" if k % n == o else x for k, x in enumerate(text.split())]
            around = (rng.choice(docs)[1] or "").split(" ")
            at = rng.randint(0, len(around))
            want[900_000 + 1000 * n + j] = str(item)
            rows.append((900_000 + 1000 * n + j, " ".join([*around[:at], *w, *around[at:]])))
    got = {r["doc_id"]: r["item_ids"].split(",") for r in decontamination.contaminated_documents(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    for n in (3, 4, 5, 6):
        found = sum(i in got[d] for d, i in want.items() if d // 1000 == 900 + n)
        assert found >= 90, (n, found)


def test_decontamination_in_blocks_of_items(spark):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs, _ = planted(spark, "/root/testdata/sf0.001")
    docs = docs.unionByName(docs.limit(20)).unionByName(spark.createDataFrame([(None, None), (3, "")], "doc_id long, text string"))
    whole = decontamination.with_leaks(docs, bench).collect()
    parts = decontamination.with_leaks(docs, bench, items_at_once=7)
    assert parts.columns == [*docs.columns, "_leaked_items"]
    show = lambda rows: sorted(key((r["doc_id"], r["text"], ",".join(map(str, r["_leaked_items"])))) for r in rows)
    assert show(whole) == show(parts.collect())


def test_surroundings_of_long_items_are_merged():
    """Merged ones cover all of the given ones, stay within one and a half item lengths more, and are few for long items."""
    rng = np.random.default_rng(2)
    n = np.array([40, 300, 1000])
    row, item = np.sort(rng.integers(0, 5, 4000)), rng.integers(0, 3, 4000)
    start = rng.integers(0, 5000, 4000)
    begin, end = start - n[item], start + 30 + n[item]
    got = np.stack(decontamination.merged_surroundings(row, item, n[item], begin, end), axis=1)
    for k in range(3):
        for r in range(5):
            own = got[(got[:, 0] == r) & (got[:, 1] == k)]
            mine = (row == r) & (item == k)
            assert all(any(a <= x and y <= b for _, _, a, b in own) for x, y in zip(begin[mine], end[mine], strict=True))
            assert (own[:, 3] - own[:, 2]).max(initial=0) <= 30 + 2.5 * n[k]
    assert (got[:, 1] == 2).sum() <= 5 * 14


def test_long_items_are_found(spark):
    """Items of a thousand words, verbatim and with every fifth word replaced."""
    rng = random.Random(3)
    vocab, weights = [f"w{i}" for i in range(3000)], [1 / (i + 1) for i in range(3000)]
    text = lambda k: rng.choices(vocab, weights, k=k)
    items = [text(1000) for _ in range(3)]
    rows = [(k, " ".join([*text(200), *[x if i % 5 or k % 2 else "new" for i, x in enumerate(items[k % 3])], *text(200)])) for k in range(12)] + [(100 + k, " ".join(text(1500))) for k in range(12)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.contaminated_documents(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert all(got[k] == str(k % 3) for k in range(12)) and not any(got[100 + k] for k in range(12))
