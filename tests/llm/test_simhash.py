"""The trie self-join's traversal, hot keys and splits."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import common, queries, simhash

from .test_text_operators import DATA, brute_components


def test_nodes_are_branched_on_the_table(spark, monkeypatch):
    """The links of the given table come out of pairs of inner nodes, not out of pairs of leaves below a root."""
    prints = simhash.fingerprints(spark.read.parquet(f"{DATA[:-5]}0.1/documents.parquet"), 4)
    fps = np.unique(np.array([r.fp for r in prints.select("fp").distinct().collect()], np.int64)).view(np.uint64)
    branched = []
    children = simhash._children
    monkeypatch.setattr(simhash, "_children", lambda *a: branched.append((len(a[0]), int(((a[1] - a[0]) * (a[4] - a[3])).max()), int(a[6].max()))) or children(*a))
    mask = np.uint64(simhash._roots(4)[0] & (1 << 64) - 1)
    src, dst = simhash.trie_links(fps, fps & mask, 4)
    assert sum(n for n, _, _ in branched) > 1000 and max(n for _, n, _ in branched) > 9 and max(d for _, _, d in branched) == 4
    near = collections.defaultdict(list)
    for x in fps.tolist():
        near[x & int(mask)].append(x)
    want = {i: r for own in near.values() for i, r in brute_components(own).items()}
    got = dict(zip(src.tolist(), dst.tolist(), strict=True))

    def top(x):
        while x in got:
            x = got[x]
        return x

    same = collections.defaultdict(set)
    for x in fps.tolist():
        same[top(x)].add(want[x])
    assert all(len(s) == 1 for s in same.values()) and len(same) == len(set(want.values()))


def test_any_two_within_the_budget_share_a_root():
    r = random.Random(1)
    for agree in (1, 2):
        for free in (-1, 0x0FFF_FFFF_0000_FFFF):
            masks = simhash._roots(4, free, agree)
            for _ in range(500):
                a = r.getrandbits(64)
                b = a
                for bit in r.sample([k for k in range(64) if free >> k & 1], 4):
                    b ^= 1 << bit
                assert any((a ^ b) & m == 0 for m in (x & (1 << 64) - 1 for x in masks))


def test_hubs_and_hot_fingerprints(spark, monkeypatch):
    """Keys with many rows take another way and change nothing."""
    monkeypatch.setattr(common, "_FEW", 3)
    monkeypatch.setattr(common, "_HOT", 5)
    r = random.Random(2)
    rows = [(0, i) for i in range(1, 60)] + [(100, 200 + i) for i in range(50)] + [(59, 100), (500, 501)]
    r.shuffle(rows)
    got = {x.node: x.root for x in simhash.components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {x: 0 for x in [*range(1, 60), 100, *range(200, 250)]} | {501: 500}
    texts = ["same words in every one of these documents here"] * 40 + [None] * 30 + [f"word{i} other{i} third{i} fourth{i} fifth{i}" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x.doc_id: x.component_id for x in simhash.group(df).collect()}
    assert len(out) == 90 and {out[i] for i in range(40)} == {0} and {out[i] for i in range(40, 70)} == {40}


def test_small_tasks_give_the_same_groups(spark, monkeypatch):
    want = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, DATA).collect()}
    monkeypatch.setattr(simhash, "_PART", 20)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, DATA).collect()} == want


def test_links_of_no_fingerprints(spark):
    assert simhash.links(spark.range(0).select(F.col("id").alias("fp"))).count() == 0
