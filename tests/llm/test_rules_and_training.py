"""Sentence ends of other scripts, and the training loop against a plain one."""

import math
import random
import re

import numpy as np
import pytest
import xxhash

from graphloom.llm import quality_classifier, quality_rules


@pytest.mark.parametrize("line", ["这是一个完整的句子。", "これは文ですか？", "「はい。」", "यह एक पूरा वाक्य है।", "هل هذه جملة كاملة؟", "یہ ایک مکمل جملہ ہے۔", "Սա ամբողջական նախադասություն է։"])
def test_sentences_of_other_scripts_pass(line):
    data = line.encode()
    assert not quality_rules.line_fails(data, data.split(), quality_rules.LineRules())
    cut = line.rstrip("".join(quality_rules.ENDS + quality_rules.CLOSINGS)).encode()
    assert quality_rules.line_fails(cut, cut.split(), quality_rules.LineRules())


def plain_ftrl(rows, bits, alpha, beta, l1, l2):
    """Follow the regularised leader, one coordinate at a time."""
    mask, mix = (1 << 64) - 1, 0x9E3779B97F4A7C15
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for text, label in rows:
        tokens = [t for w in text.split() for t in re.findall(r"\w+|[^\w\s]+", w)]
        h = [xxhash.xxh64_intdigest(t.encode()) for t in tokens]
        pairs = [1 if a == b else ((a * mix & mask) ^ (b + mix & mask)) for a, b in zip(h, h[1:], strict=False)]
        counts = {}
        for x in h + pairs:
            i = (x * mix & mask) >> (64 - bits)
            counts[i] = counts.get(i, 0) + 1
        x = [(i, c / math.sqrt(max(1, sum(counts.values())))) for i, c in counts.items()] + [((1 << bits) - 1, 1.0)]
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x)))
        step = []
        for i, v in x:
            g = (p - label) * v
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
            step.append((i, g - sigma * weight(i), g * g))
        for i, dz, dn in step:
            z[i], n[i] = z.get(i, 0.0) + dz, n.get(i, 0.0) + dn
    return {i: weight(i) for i in z}


@pytest.mark.parametrize("l1,l2", [(0.0, 1.0), (0.05, 0.2)])
def test_training_against_a_plain_loop(l1, l2):
    r = random.Random(1)
    words = ["good", "Bad,", "x1", "the", "the", "...", "naïve", "a.b"]
    rows = [(" ".join(r.choice(words) for _ in range(r.randint(0, 12))), r.randint(0, 1)) for _ in range(200)]
    got = quality_classifier.train(((t.encode(), y) for t, y in rows), 18, 0.3, 1.0, l1, l2)
    want = plain_ftrl(rows, 18, 0.3, 1.0, l1, l2)
    dense = np.zeros(1 << 18)
    dense[list(want)] = list(want.values())
    assert np.allclose(got, dense, atol=1e-12) and np.count_nonzero(got) > 10


def test_more_labels_than_the_bound_and_repeated_rows(spark):
    rows = [(i, f"text {'good' if i % 2 else 'bad'} {i}") for i in range(60)] + [(1, "text good 1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1), (1, 0)], "doc_id long, quality int")
    some = {(r.doc_id, r.score) for r in quality_classifier.classify(docs, labels, bits=14, max_train=10).collect()}
    every = {(r.doc_id, r.score) for r in quality_classifier.classify(docs, labels, bits=14).collect()}
    assert len(some) == len(every) == 60 and some != every
