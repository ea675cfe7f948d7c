import collections
import re
import zlib

import numpy as np

import corpus_pipeline
from netquarry.llm import classifier

from .test_free import JSON, brute_classes
from .test_native import WORD, brute_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def leaked(text, items):
    w = text.split()
    grams = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    return any(sum(tuple(i[k : k + 4]) in grams for k in range(len(i) - 3)) >= 0.5 * (len(i) - 3) for i in items)


def test_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]

    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == COLUMNS and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        now = spark.createDataFrame(now.collect(), now.schema)
        seen[name] = texts(now)

    net = classifier.train(classifier.sample(docs, labels))
    want = {d: t for d, t in texts(docs).items() if round(net.score(np.frombuffer((t or "").encode(), np.uint8)), 6) >= 0.7}
    assert seen["quality classifier"] == want
    cut = brute_lines(list(want.items()))
    want = {d: t for d, t in cut.items() if t == want[d] or WORD.search(t)}
    assert seen["line dedup"] == want
    classes = brute_classes(list(want.items()))
    want = {d: t for d, t in want.items() if classes[d][2]}
    assert seen["MinHash near-dedup"] == want
    items = [r["text"].split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {d: t for d, t in want.items() if not leaked(t, items)}
    assert seen["benchmark decontamination"] == want

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    pieces = collections.Counter()
    for d, text in want.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        pieces.update((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == pieces
    assert len({r["sequence_id"] for r in got}) <= -(-sum(r["length"] for r in got) // 2048) + 2
    assert re.fullmatch(r"\d+", str(got[0]["sequence_id"]))
