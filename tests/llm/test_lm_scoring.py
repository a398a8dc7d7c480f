"""Cross-entropy difference against plain dictionaries, whatever the batches and parts are."""

import collections
import math
import random

import numpy as np
import pytest

from graphloom.llm import lm_scoring


def brute(docs, target, m):
    """(target loss, background loss) of each row, from counts without the row itself. docs: list of (id, text)."""
    events = []
    for _, text in docs:
        words = (text or "").encode().lower().split()
        events.append(list(zip([1, *words], [*words, 2], strict=True)) if words else [])
    sides = {"b": range(len(docs)), "t": [k for k, (i, _) in enumerate(docs) if i in target]}
    pairs = {s: collections.Counter(e for k in rows for e in events[k]) for s, rows in sides.items()}
    words = {s: collections.Counter(w for k in rows for _, w in events[k]) for s, rows in sides.items()}
    firsts = {s: collections.Counter(v for k in rows for v, _ in events[k]) for s, rows in sides.items()}
    n = {s: sum(c.values()) for s, c in words.items()}
    out = []
    for k, (i, _) in enumerate(docs):
        own = [collections.Counter(x) for x in (events[k], [w for _, w in events[k]], [v for v, _ in events[k]])]
        losses = []
        for s in "tb":
            here = int(s == "b" or i in target)
            total = 0.0
            for v, w in events[k]:
                g = words["b"][w] / n["b"]
                p1 = (words[s][w] - here * own[1][w] + m * g) / (n[s] - here * len(events[k]) + m)
                total -= math.log((pairs[s][v, w] - here * own[0][v, w] + m * p1) / (firsts[s][v] - here * own[2][v] + m))
            losses.append(total / len(events[k]) if events[k] else None)
        out.append((i, len(events[k]) - 1 if events[k] else 0, *losses))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_tokens, r.loss_target, r.loss_background, r.score) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3] or 0))


def check(got, want):
    want = sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3] or 0))
    assert len(got) == len(want)
    for (i, n, t, b, s), (j, k, u, c) in zip(got, want, strict=True):
        assert (i, n) == (j, k)
        assert (t, b, s) == (None, None, 0.0) if u is None else np.allclose((t, b, s), (u, c, u - c))


def corpus(seed, n, words=40, length=25):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(["w", "W", "x,"]) + str(min(int(r.paretovariate(0.8)), words)) for _ in range(r.randint(0, length)))) for i in range(n)]


@pytest.mark.parametrize("prior", [0.5, 1000.0])
def test_losses_against_brute_force(spark, prior):
    docs = [*corpus(1, 60), (100, None), (101, " \n\t "), (102, " \x0b One\tone\r\nONE one two "), (None, "w1 w2 w3"), (7, "w1 x,2"), (7, "w1 x,2")]
    target = {i for i in range(60) if i % 3 == 0}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = lm_scoring.score(df, spark.createDataFrame([(i,) for i in [*target, *target, 5000, None]], "doc_id long"), prior)
    check(rows_of(got), brute(docs, target, prior))


def test_every_batch_and_part_gives_the_same(spark, monkeypatch):
    """Small batches, many parts and marks that are joined by a shuffle change nothing."""
    docs, target = corpus(2, 80), set(range(0, 80, 5))
    df, marks = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(i,) for i in target], "doc_id long")
    want = brute(docs, target, 5.0)
    check(rows_of(lm_scoring.score(df, marks, 5.0)), want)
    monkeypatch.setattr(lm_scoring, "_BATCH", 200)
    monkeypatch.setattr(lm_scoring, "_PART", 60)
    monkeypatch.setattr(lm_scoring, "_SENT", 3)
    check(rows_of(lm_scoring.score(df, marks, 5.0)), want)


def test_every_word_and_bigram_counts_at_half_a_million_tokens(spark):
    r = random.Random(8)
    docs = [(i, " ".join(f"w{min(int(r.paretovariate(0.7)), 400_000)}" for _ in range(1300))) for i in range(420)]
    target = {i for i in range(420) if i % 3 == 0}
    got = lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i,) for i in target], "doc_id long"))
    check(rows_of(got), brute(docs, target, 1000.0))


def test_documents_that_occur_twice_score_apart(spark):
    r = random.Random(4)
    text = lambda: " ".join(f"r{r.randint(0, 5000)}" for _ in range(80))
    twice = text()
    docs = [(i, text()) for i in range(50)] + [(100, twice), (101, twice)]
    got = {x.doc_id: x.loss_background for x in lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert max(got[100], got[101]) < min(v for i, v in got.items() if i < 50) - 1


def test_no_target_and_any_kind_of_id(spark):
    df = spark.createDataFrame([("a", "one two two"), ("b", "two three"), (None, "one")], "doc_id string, text string").selectExpr("*", "1 AS mark", "2 AS id", "3 AS part")
    got = {r.doc_id: r for r in lm_scoring.score(df, df.where("false"), 3.0).collect()}
    words = {"one": 2, "two": 3, "three": 1, "end": 3}
    want = -sum(math.log(words[w] / 9) for w in ("two", "three", "end")) / 3
    assert set(got) == {"a", "b", None} and np.isclose(got["b"].loss_target, want)


def test_hashes_and_counts_are_packed_without_loss():
    r = np.random.default_rng(0)
    for n in (1, 2, 1000):
        for top in (1 << 64, 1 << 20):
            h = np.sort(r.integers(0, top, n, dtype=np.uint64))
            assert (lm_scoring._unpack_hashes(lm_scoring._pack_hashes(h)) == h).all()
    a, b = np.array([0, 1, 255, 256, 1 << 40]), np.zeros(0, np.int64)
    x, y = lm_scoring._unpack(lm_scoring._pack(a, b))
    assert x.tolist() == a.tolist() and len(y) == 0
