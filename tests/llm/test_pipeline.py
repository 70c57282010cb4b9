import os
import random
import sys

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute
from test_operators import ROWS, folders  # noqa: F401

import corpus_pipeline
from keyloom.llm import mixing, neardup, quality, sharding

SF = "/root/testdata/sf0.001"


def sql(query, docs):
    con = duckdb.connect()
    con.register("documents_", docs)
    con.execute("create view documents as select * from documents_")
    rel = con.sql(query)
    return [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r["doc_id"] for r in sql(quality.ORACLE, docs) if r["kept"]}
    docs = docs[docs.doc_id.isin(kept)]
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    rows.sort()
    groups = brute.near_groups([t for _, t in rows])
    assert len(set(groups)) < len(rows)
    docs = docs[docs.doc_id.isin({rows[g][0] for g in groups})]
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    docs = docs[docs.doc_id.isin({r[0] for r in brute.decontaminate(rows, items) if not r[-1]})]
    docs = docs[docs.doc_id.isin({r["doc_id"] for r in sql(mixing.ORACLE, docs) if r["sampled"]})]
    tree = sharding.base_tree()
    want = sorted((d, *brute.size_and_crc(t), brute.shard(d, tree), brute.shard(d, sharding.grow(tree, 8))) for d, t in zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    got = corpus_pipeline.run(spark, SF).collect()
    assert want and sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want


@pytest.mark.parametrize("name", ["edge", "empty"])
def test_stages_keep_columns_and_survive_edges(spark, folders, name):  # noqa: F811
    docs = spark.read.parquet(f"{folders[name]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folders[name])
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) <= (len(ROWS) if name == "edge" else 0)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folders[name]).count() == (len(ROWS) if name == "edge" else 0)


def test_one_document_of_each_group_stays(spark, folders):  # noqa: F811
    docs = spark.read.parquet(f"{folders['edge']}/documents.parquet")
    stay = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, folders["edge"]).collect()
    rows = sorted(((d, t) for d, t, *_ in ROWS), key=lambda r: (r[0] is None, r[0] or 0))
    groups = brute.near_groups([t for _, t in rows])
    # of rows with the same id either text may stay
    assert sorted(str(r["doc_id"]) for r in stay) == sorted(str(rows[g][0]) for g in set(groups))


def variants(seed, n):
    """A text and copies of it with words changed, so that similarities lie on both sides of 0.8."""
    r = random.Random(seed)
    words = [f"w{r.randrange(500)}" for _ in range(r.randrange(30, 120))]
    out = [" ".join(words)]
    for _ in range(n - 1):
        w = list(words)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"x{r.randrange(500)}"
        out.append((" ".join(w)).upper() if r.random() < 0.1 else "  ".join(w))
    return out


def test_near_copies_against_brute_force(spark):
    rows = list(enumerate(t for seed in range(12) for t in variants(seed, 1 + 3 * seed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(set(brute.near_groups([t for _, t in rows])))
    assert 12 < len(want) < len(rows)
    for caps in ({}, {"chunk_rows": 2}, {"chunk_bytes": 500}):  # small chunks split every group
        assert sorted(r["doc_id"] for r in neardup.near_dedup(docs, **caps).collect()) == want


def test_comparison_joins_the_same_groups_in_any_order():
    texts = [t for seed in range(6) for t in variants(seed, 20)]
    sets = [neardup.shingle_set(t.encode()) for t in texts]
    fp = np.array([neardup.majority(s) for s in sets], np.uint64)
    groups = brute.near_groups(texts)
    sid = np.arange(len(texts))
    for seed in range(3):
        mixed = np.random.default_rng(seed).permutation(sid)
        a, b = neardup.exact_links(mixed, [sets[i] for i in mixed], fp[mixed], 64)
        root = {int(x): int(y) for x, y in zip(a, b, strict=True)}
        got = [root.get(i, i) for i in range(len(texts))]
        assert len(set(zip(got, groups, strict=True))) == len(set(got)) == len(set(groups))


def distant_pairs(sizes, least, n, seed):
    """n pairs of texts with so many shingles each, the fewer inside the more, whose fingerprints differ in at least so many bits."""
    r, out = random.Random(seed), []
    while len(out) < n:
        words = [f"w{r.randrange(10**6)}" for _ in range(sizes[1] + 4)]
        pair = [" ".join(words[: sizes[0] + 4]), " ".join(words)]
        a, b = (neardup.majority(neardup.shingle_set(t.encode())) for t in pair)
        if (a ^ b).bit_count() >= least:
            out.append(pair)
    return out


def test_similar_texts_with_distant_fingerprints_are_joined(spark):
    # a pair at 0.8 misses all bands with probability 3e-5
    pairs = distant_pairs((4, 5), 25, 1, 1) + distant_pairs((4, 5), 21, 4, 2) + distant_pairs((12, 15), 21, 2, 3)
    rows = list(enumerate(t for pair in pairs for t in pair))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardup.near_dedup(docs).collect()) == list(range(0, len(rows), 2))
    sets = [neardup.shingle_set(t.encode()) for t in pairs[0]]
    fp = np.array([neardup.majority(x) for x in sets], np.uint64)
    assert len(neardup.exact_links(np.arange(2), sets, fp)[0]) == 1
