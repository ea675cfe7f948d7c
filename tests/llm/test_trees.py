"""Merkle manifests, token files and prefix tries against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from netquarry.llm import grammar, merkle, ordered, prefix_trie, queries, token_files
from netquarry.llm.queries import tokenizer_file

from . import fixtures
from .test_free import documents, key

WORDS = tokenizer_file("word_bpe_49k.json")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Merkle manifest


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(hashes, arity):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def proof_and_fold(tree, index, digest, arity):
    """Siblings level by level, and what the digest folds to."""
    siblings = []
    for level in tree[:-1]:
        run = level[index // arity * arity :][:arity]
        siblings += run[: index % arity] + run[index % arity + 1 :]
        digest = H(*run[: index % arity], digest, *run[index % arity + 1 :])
        index //= arity
    return siblings, digest


def brute_manifest(rows, arity=16):
    """rows: (doc_id, source, lang, n_chars, text)."""
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    by = collections.defaultdict(list)
    for r in rows:
        own = leaf(r)
        bad = leaf((*r[:4], lower(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else own
        by[r[1]].append((r[0] is not None, r[0] or 0, own, bad))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[2] for x in sorted(by[s])], arity) for s in sources]
    top = levels([t[-1][0] for t in trees], arity)
    out = []
    for k, s in enumerate(sources):
        for i, (there, doc_id, own, bad) in enumerate(sorted(by[s])):
            low, folded = proof_and_fold(trees[k], i, bad, arity)
            high, folded = proof_and_fold(top, k, folded, arity)
            out.append((doc_id if there else None, own, trees[k][-1][0], top[-1][0], H(*low, *high), folded, folded == top[-1][0]))
    return out


def manifest_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=key)


def check_manifest(docs, arity=16, fan=merkle.FAN):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = manifest_rows(merkle.manifest(docs, checked=merkle.tampered(docs), arity=arity, fan=fan))
    assert got == sorted(brute_manifest(rows, arity), key=key)


def test_manifest(spark, sf_dir):
    check_manifest(documents(spark, sf_dir))
    check_manifest(documents(spark, sf_dir), arity=2, fan=3)
    check_manifest(fixtures.awkward(spark))
    assert merkle.manifest(fixtures.empty(spark)).count() == 0


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1] * 17, [256, 1, 15], [3, 300, 33], [2] * 40])
def test_manifest_of_tree_sizes(spark, sizes):
    rows = [(10 * k + i * 1000, f"text {i} OF {k}", "en", f"s{k:03}", i, "x", 7, "r") for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    check_manifest(spark.createDataFrame(rows, fixtures.DOC_SCHEMA))


def test_manifest_clashing_columns(spark):
    docs = fixtures.awkward(spark).withColumnsRenamed({"gone": "leaf", "n": "part", "rep": "_key"})
    check_manifest(docs)


def test_forests_merge_in_any_order():
    rng = random.Random(3)
    sizes = [1, 5, 37, 16, 1, 260]
    nodes = [(t, i) for t, n in enumerate(sizes) for i in range(n)]
    whole = []
    for cuts in (1, 4, 9):
        rng.shuffle(nodes)
        forests = []
        for c in range(cuts):
            f = merkle.Forest(len(sizes))
            for t, i in nodes[c::cuts]:
                f.add(t, 0, i, H(str(t), str(i)), c)
            if c == cuts - 1:
                for t, n in enumerate(sizes):
                    f.close(t, n, c)
            forests.append(f)
        runs = [r for f in forests for r in f.take()]
        rng.shuffle(forests)
        last = merkle.Forest(len(sizes))
        rest = [r for f in forests for r in f.rest()]
        rng.shuffle(rest)
        for kind, tree, level, index, label, hashes, _ in rest:
            last.add(tree, level, index, hashes[0], label) if kind == "node" else last.close(tree, index, label)
        assert not last.rest()
        runs += last.take()
        whole.append(sorted((r[0], r[1], r[2] or 0, r[3] or 0, r[5]) for r in runs))
    assert whole[0] == whole[1] == whole[2]


def test_numbered_groups_over_ranges(spark):
    """One group lies in most ranges; polynomials and places go on over their ends."""
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else rng.choice([None, "a", "z", "hot2"]), i, rng.randrange(1000)) for i in range(3000)]
    p = ordered.Polynomial("h", 7919, 2147483647)
    got, groups = ordered.numbered(spark.createDataFrame(rows, "g string, i long, h long").repartition(5), "g", ["i"], "t", (p,))
    want, names = [], sorted({r[0] for r in rows}, key=lambda x: (x is not None, x or ""))
    for n, name in enumerate(names):
        total, own = 0, sorted(r for r in rows if r[0] == name)
        for k, (_, i, h) in enumerate(own):
            before, total = total, (total + h * pow(p.base, k, p.prime)) % p.prime
            want.append((i, n, k, k == len(own) - 1, total, before))
    assert groups == len(names)
    assert sorted(tuple(r) for r in got.select("i", "group_no", "place", "last", "f0", "g0").collect()) == sorted(want)


# token files


@pytest.mark.parametrize("ids", [[], [5], [7] * 1000, list(range(300)), [1, 2] * 500, [1, 1, 2] * 300, np.random.default_rng(1).zipf(1.3, 20000) % 500])
def test_grammar_round_trip(ids):
    ids = np.array(ids, np.uint32)
    terminals, rules, sequence = grammar.compress(ids, 4)
    shard = grammar.Shard(grammar.to_bytes(ids, 4))
    assert shard.read(0, len(shard)).tolist() == ids.tolist()
    rng = random.Random(1)
    for _ in range(200):
        a = rng.randint(-3, len(ids) + 3)
        b = a + rng.randint(0, 60)
        assert shard.read(a, b).tolist() == ids[max(0, a) : max(0, b)].tolist()
    # No pair is left that is frequent, but for those inside runs of one symbol.
    pairs = collections.Counter(zip(sequence.tolist(), sequence[1:].tolist(), strict=False))
    assert all(n < 4 or a == b for (a, b), n in pairs.items())
    assert len(sequence) + 3 * len(rules) <= max(len(ids), 1)


def test_tokens_are_those_of_whole_texts(spark, sf_dir):
    encoder = token_files.StretchEncoder(WORDS)
    odd = ["a  b\n\nc <|endoftext|> x<|endoftext|>y", "Ünï É <|ENDOFTEXT|> it's IT'S H̱a Å, Σας ΣΑΣ", "x\x1cy\x85z w\tq it's,ok don't.stop 12,3 a.b", "İstanbul 中文,字 é, ﬁ,x '.s a's. ʰ, ª, ×,", "\x00 \x00,a ​, 😀,😀 ẞ.", None, "", " ", "the,the,the the"]
    texts = [r["text"] for r in documents(spark, sf_dir).collect()] + odd
    import pyarrow as pa

    for _ in range(2):
        ids, sizes = encoder.encode(pa.array(texts))
        want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
        token_files.REMEMBERED, kept = 10, token_files.REMEMBERED
    token_files.REMEMBERED = kept


def check_files(docs, shard_ids=token_files.SHARD_IDS):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(WORDS).encode
    shards = token_files.token_shards(docs, WORDS, shard_ids=shard_ids).cache()
    got = token_files.read_documents(shards).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = collections.Counter((d, *encode(t or "", add_special_tokens=False).ids, 1) for d, t in rows)
    assert collections.Counter((r["doc_id"], *r["ids"]) for r in got) == want
    start, stream = 0, []
    for r in sorted(got, key=lambda r: r["start"]):
        assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += len(r["ids"])
        stream += r["ids"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    digests = sorted((tuple(r) for r in token_files.document_digests(shards).collect()), key=key)
    assert digests == sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key)
    for a, b in ((0, 10), (len(stream) // 3, len(stream) // 2), (len(stream) - 5, len(stream) + 9)):
        pieces = sorted(tuple(r) for r in token_files.read_range(shards, a, b).collect())
        assert [x for _, ids in pieces for x in ids] == stream[a:b]
        assert pieces[0][0] == a
    shards.unpersist()


def test_token_files(spark, sf_dir):
    check_files(documents(spark, sf_dir))
    check_files(documents(spark, sf_dir), shard_ids=700)
    check_files(fixtures.awkward(spark), shard_ids=50)
    assert token_files.document_digests(token_files.token_shards(fixtures.empty(spark), WORDS)).count() == 0


# prefix trie


def brute_trie(rows):
    """rows: (conv_id, turn, role, text); nodes as the query returns them."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        built[c] = (own.get(c - c % 5, [])[:h] if c is not None else []) + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    smallest = {node: min((c for c in m if c is not None), default=None) for node, m in members.items()}
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, m in members.items():
        ends = sorted(c for c in m if c is not None and len(built[c]) == len(node))
        out.append((smallest[node], len(node), smallest[node[:-1]] if node else None, len(m), len(children[node]), leaves[node], saved[node], H(",".join(map(str, ends)))))
    return out


def check_trie(conversations, primes=prefix_trie.PRIMES):
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    turns, convs = prefix_trie.rebuilt(conversations)
    got = prefix_trie.prefix_trie(turns, convs, ["own", "i"], primes)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(brute_trie(rows), key=key)


def some_conversations(n, seed, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 12])):
            rows.append((c * rng.choice([1, 1, 1, 7]), rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "é", *"abc"[:words]])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_prefix_trie(spark, sf_dir):
    check_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    odd = [(None, 1, "user", "a"), (None, 1, "user", "a"), (0, 5, "user", "a"), (-3, 0, "user", "x"), (-3, 1, "user", "y"), (-5, 1, "user", "z"), (2, None, None, None)]
    extra = spark.createDataFrame(some_conversations(60, 1) + odd, SCHEMA).selectExpr("*", "1 as f", "2 as depth", "3 as own", "4 as place")
    check_trie(extra)
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(*prefix_trie.rebuilt(empty), ["own", "i"]).count() == 0


def test_colliding_fingerprints_are_split(spark):
    rows = [(c, t, "user", f"{t} {random.Random(c // 3 * 31 + t).randrange(40)}") for c in range(90) for t in range(4)]
    check_trie(spark.createDataFrame(rows, SCHEMA), (17, 13))
    scanned = prefix_trie.fingerprints(*[prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA))[0], ["own", "i"]], primes=(17, 13))
    texts = scanned.groupBy("depth", "f").agg({"text": "max", "role": "max", "g": "max"}).count()
    assert texts < scanned.select("depth", "f", "g", "text").distinct().count()


def test_one_long_conversation(spark):
    """It holds most rows, and so lies in many ranges."""
    rows = [(5, t, "user", f"t{t}") for t in range(700)] + [(10, t, "user", f"t{t}") for t in range(690)] + [(c, 0, "user", "one") for c in range(11, 40)]
    check_trie(spark.createDataFrame(rows, SCHEMA).repartition(7))


def test_new_queries_run(spark, sf_dir):
    docs = documents(spark, sf_dir).count()
    assert queries.QUERIES["op11_merkle_manifest"](spark, sf_dir).count() == docs
    assert queries.QUERIES["op12_token_files"](spark, sf_dir).count() == docs
    assert queries.QUERIES["op13_prefix_trie"](spark, sf_dir).where("depth = 0").count() == 1
