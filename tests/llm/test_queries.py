"""The queries and the pipeline over the smallest tables."""

import re
from itertools import combinations

import pytest

import corpus_pipeline
from chunklake.llm import decontam, mixing, quality, queries, shards
from chunklake.llm.queries import QUERIES
from chunklake.llm.sql import ORACLE_SQL
from tests.compare import connect, rows

CONTRACT = {
    "op2": ["doc_id:bigint", "held_out:boolean", "lang_pred:string", "score:double"],
    "op4": ["doc_id:bigint", "n_words:bigint", "n_hit:bigint", "n_items:bigint", "items_sha256:string", "contaminated:boolean"],
    "op5": ["doc_id:bigint", "size:bigint", "text_crc32:bigint", "law:string", "shard:int", "slot:bigint", "grown_shard:int"],
    "op6": ["page_id:bigint", "url:string", "text:string", "n_chars:bigint"],
    "op7": ["doc_id:bigint", "fingerprint:string", "component_id:bigint"],
    "op8": ["doc_id:bigint", "held_out:boolean", "score:double", "predicted:int"],
    "op10": ["doc_id:bigint", "held_out:boolean", "score:double", "predicted:int"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    out = QUERIES[name](spark, sf)
    table = "pages" if name.startswith("op6") or "page" in name else "embeddings" if name.startswith("op3") else "documents"
    n = spark.read.parquet(f"{sf}/{table}.parquet")
    if name == "op3_chroma_matches":  # a row for each class of recordings that a query meets, or one of nulls
        assert {r.vec_id for r in out.select("vec_id").collect()} == {r.vec_id for r in n.filter("vec_id % 20 = 0").collect()}
        assert out.count() == out.select("vec_id", "match_class").distinct().count()
    elif name == "benchmark_spans":
        texts = {r.doc_id: r.text for r in n.collect()}
        hit = {r.doc_id: r.n_hit for r in QUERIES["op4_decontamination"](spark, sf).filter("contaminated").collect()}
        words = dict.fromkeys(hit, 0)
        for r in out.collect():
            words[r.doc_id] += len(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", texts[r.doc_id][r.start : r.end]))
        assert words == hit
    else:
        assert out.count() == (n.filter("vec_id % 20 = 0") if name == "op3_chroma_search" else n).count()
    want = CONTRACT.get(name.split("_")[0], [])
    assert [f"{a}:{b}" for a, b in out.dtypes][: len(want)] == want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(connect(sf).sql(ORACLE_SQL[name]).df())


def firsts_of_near_copies(texts):
    """Smallest id of each group linked by a Jaccard similarity of five-word shingles of 0.8 or more; every pair is looked at."""
    sets = {}
    for i, t in texts.items():
        w = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        x, y = sets[i], sets[j]
        if len(x & y) >= 0.8 * len(x | y):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return {top(i) for i in sets}


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, quality.learn_fold(labels)))
    at = docs
    want = {r.doc_id for r in scored.filter("score >= 0.5").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, at, sf).cache()
        got = {r.doc_id for r in after.collect()}
        assert got <= ids and after.count() == len(got)
        if k == 0:
            assert got == want
        elif k == 1:
            assert got == firsts_of_near_copies({r.doc_id: r.text for r in at.collect()})
        elif k == 2:
            assert got == {r.doc_id for r in decontam.contamination(at, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("size(contamination.hits) = 0").collect()}
        elif k == 3:
            assert got == {r.doc_id for r in mixing.mix(at, 0.9, 1, weights=queries.TARGETS, domains=queries.DOMAINS).filter("copies > 0").collect()}
        else:
            assert sorted(map(str, after.collect())) == sorted(map(str, shards.shard(at).collect()))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        ids, at = got, after
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == ids
