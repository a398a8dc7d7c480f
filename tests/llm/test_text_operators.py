"""The operators on texts against brute force, and on awkward tables."""

import collections
import hashlib
import itertools
import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import line_dedup, lm_scoring, mixing, quality_classifier, quality_rules, queries, sentencepieces, simhash, token_files

DATA = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


# Quality rules ------------------------------------------------------------------------------------------------------
def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_base_statistics_against_brute_force(spark):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in queries.op1_quality_rules(spark, DATA).collect()}
    assert got == {i: brute_base(t) for i, t in documents(spark)}


def test_repeats_against_brute_force():
    r = random.Random(3)
    for _ in range(300):
        text = " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))
        assert quality_rules.repeated_words(text.encode().split()) == brute_base(text)[4]


@pytest.mark.parametrize("line,fails", [
    ("This is a plain sentence.", False), ("He said «enough.» and left", False), ("no end in sight", True), ("Home | News | About | Contact.", True), ("A | B and C then D.", False), ("ALL WORDS ARE SHOUTED HERE TODAY.", True),
    ("wow!! so!! very!! loud!! here!!", True), ("a### b&&& c$$$ d.", True), ("It costs $5 and that is fine.", False), ("Er " * 30 + ".", True), ("© 2024 Foo. All rights reserved.", True), ("", False),
])
def test_line_rules(line, fails):
    data = line.encode()
    words = data.split()
    assert bool(words and quality_rules.line_fails(data, words, quality_rules.LineRules())) is fails


def test_clean_drops_lines_and_documents(spark):
    good = "This is a good sentence with quite enough words in it to count as text, and it ends well."
    more = "Another line follows the first one, and nothing in it was said before by anybody at all."
    rows = [(1, f"{good}\n{more}\nMenu | Home | About | Help"), (2, "Menu | Home | About | Help\n" * 10), (3, None)]
    out = {r.doc_id: (r.text, r.n_chars) for r in quality_rules.clean(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))).collect()}
    want = f"{good}\n{more}"
    assert out == {1: (want, len(want))}


# Line dedup ---------------------------------------------------------------------------------------------------------
def brute_lines(docs, min_docs):
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(blank))
    count = collections.Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not key(x) or count[key(x)] < min_docs]
        out[i] = (len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    return out


def test_line_dedup_against_brute_force(spark):
    docs = documents(spark)
    for least in (2, 10):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digests(spark.createDataFrame(docs, "doc_id long, text string"), least).collect()}
        assert got == brute_lines(docs, least)


def test_line_dedup_keeps_columns_and_short_keys(spark):
    rows = [(i, "É\n  Same LINE \nown %d" % i, "s") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = line_dedup.dedup(df, 3, min_chars=2)
    assert out.columns == df.columns
    assert sorted(r.text for r in out.collect()) == [f"É\nown {i}" for i in range(3)]


# SimHash ------------------------------------------------------------------------------------------------------------
def brute_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits=4):
    top = {f: f for f in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    every = sorted(top)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {f: find(f) for f in every}


def test_simhash_against_brute_force(spark):
    docs = documents(spark)
    prints = {i: brute_fingerprint(t) for i, t in docs}
    roots = brute_components(prints.values())
    least = {}
    for i, f in prints.items():
        least[roots[f]] = min(least.get(roots[f], i), i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, DATA).collect()}
    assert got == {i: (f"{f:016x}", least[roots[f]]) for i, f in prints.items()}


def test_trie_finds_every_link_of_dense_and_sparse_groups(spark):
    r = random.Random(11)
    centre = r.getrandbits(64)
    ball = {centre}
    while len(ball) < 400:
        x = centre
        for b in r.sample(range(64), r.randint(0, 7)):
            x ^= 1 << b
        ball.add(x)
    fps = sorted(ball | {r.getrandbits(64) for _ in range(600)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = brute_components(fps)
    for most in (8192, 150):  # 150: dense roots are split
        edges = simhash.links(df, 4, most)
        top = {signed(f): signed(f) for f in fps}

        def find(x, top=top):
            while top[x] != x:
                x = top[x]
            return x

        for e in edges.collect():
            a, b = find(e.src), find(e.dst)
            top[max(a, b)] = min(a, b)
        same = collections.defaultdict(set)
        for f in fps:
            same[find(signed(f))].add(want[f])
        assert all(len(s) == 1 for s in same.values()) and len(same) == len(set(want.values()))


def test_stars_join_long_chains(spark):
    r = random.Random(2)
    ids = list(range(60))
    r.shuffle(ids)
    rows = [(ids[i], ids[i + 1]) for i in range(58)] + [(100, 101), (7, 7)]
    got = {x.node: x.root for x in simhash.components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert {got.get(i, i) for i in ids[:59]} == {min(ids[:59])} and got[101] == 100


def test_dedup_keeps_the_smallest_id(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(5, text, "a"), (3, text, "b"), (9, "something else entirely with other words in it", "c"), (4, None, "d"), (6, "", "e")], "doc_id long, text string, source string")
    out = simhash.dedup(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [3, 4, 9]


def test_dedup_of_repeated_null_and_clashing_ids(spark):
    text, other, third = "one two three four five six seven eight nine ten", "a wholly unlike text with many other words in it", "red green blue cyan pink gold grey teal plum lime"
    rows = [(1, text), (1, text), (2, text), (2, other), (2, other), (None, text), (None, third), (None, third), (9, None), (9, "")]
    out = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.text or None) for r in out) == {(1, text): 1, (2, other): 1, (None, third): 1, (9, None): 1}


# Mixing -------------------------------------------------------------------------------------------------------------
def test_mixture_deviates_less_than_a_block(spark):
    sizes = {"a": 1500, "b": 300, "c": 40, None: 60}
    rows = [(i, s) for s, n in sizes.items() for i in range(n * 1000, n * 1000 + n)]
    block = 4
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights={"a": 3.0, "b": 2.0, "c": 0.5}, default_weight=0.5, block=block, slots=60)
    got = [(r.position, r.source) for r in out.collect()]
    assert len(got) == len(rows) and got == sorted(got, key=lambda x: x[0]) and len({p for p, _ in got}) == len(rows)
    slots = [s for p, s in dict.fromkeys((p // block, s) for p, s in got)]
    left = {s: -(-n // block) for s, n in sizes.items()}
    assert collections.Counter(slots) == left
    # the fluid schedule: sources with blocks left advance at their whole-block rates
    rate = {"a": 30, "b": 20, "c": 5, None: 5}
    done, fluid = collections.Counter(), dict.fromkeys(sizes, 0.0)
    for t, s in enumerate(slots, 1):
        done[s] += 1
        budget = 1.0
        while budget > 1e-9:
            live = [x for x in sizes if fluid[x] < left[x] - 1e-9]
            total = sum(rate[x] for x in live)
            dt = min([budget / total, *((left[x] - fluid[x]) / rate[x] for x in live)])
            for x in live:
                fluid[x] += rate[x] * dt
            budget -= total * dt
        assert all(abs(done[x] - fluid[x]) < 1 for x in sizes), (t, dict(done), fluid)


def test_mixture_of_awkward_tables(awkward, nothing):
    out = mixing.mix(awkward, block=2, slots=10)
    assert out.columns == [*awkward.columns, "position"] and out.count() == awkward.count()
    assert mixing.mix(nothing).count() == 0


# SentencePiece ------------------------------------------------------------------------------------------------------
def test_ids_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    fst = sentencepieces.load(PIECES)
    r = random.Random(1)
    letters = "abcdeaeei  \n\t▁<s>é漢字🙂ñ.,!1234́\x00the ing tion▁▁"
    cases = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["", " ", "\n", "▁", "<s></s>", "<0x41>", " " * 40 + "x"] + [t for _, t in documents(spark)]
    for text in cases:
        ids = np.frombuffer(fst.encode(text), "<i4")
        assert ids.tolist() == library.encode(text), text
        assert fst.decode(ids) == library.decode(ids.tolist()), text


def test_new_words_take_few_steps():
    """Lines run by the transducer for each character of words that it hasn't seen."""
    fst = sentencepieces.load(PIECES)
    r = random.Random(9)
    text = " ".join("".join(r.choice("aeiouélnrstdhmß") for _ in range(r.randint(6, 14))) for _ in range(2000))
    fst.paths.clear()
    fst.follows.clear()
    lines = 0

    def count(frame, event, arg):
        nonlocal lines
        if frame.f_code.co_filename != sentencepieces.__file__:
            return None
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        fst.encode(text)
    finally:
        sys.settrace(before)
    assert lines < 40 * len(text), lines / len(text)


def test_paths_equal_merging_for_small_models():
    r = random.Random(4)
    letters = [(f"<0x{b:02X}>", 0.0, sentencepieces.BYTE) for b in range(256)]
    for ordered in (True, False) * 10:
        found = ["a", "b"]
        for _ in range(r.randint(1, 9)):
            piece = r.choice(found) + r.choice(found)
            if piece not in found and len(piece) < 7:
                found.append(piece)
        ranks = list(range(len(found)))
        if not ordered:
            r.shuffle(ranks)
        pieces = [(p, -float(k), sentencepieces.NORMAL) for p, k in zip(found, ranks, strict=True)]
        score = {p: s for p, s, _ in pieces}
        fst = sentencepieces.Transducer(sentencepieces.Model(letters + pieces, merges=True, byte_fallback=True, dummy_prefix=False))
        for text in map("".join, itertools.chain.from_iterable(itertools.product("ab", repeat=n) for n in range(1, 9))):
            parts = list(text)
            while best := max(((score[x + y], -i) for i, (x, y) in enumerate(itertools.pairwise(parts)) if x + y in score), default=None):
                parts[-best[1] : 2 - best[1]] = ["".join(parts[-best[1] : 2 - best[1]])]
            assert np.frombuffer(fst.encode(text), "<i4").tolist() == [256 + found.index(p) for p in parts], (text, pieces)
        assert np.frombuffer(fst.encode("acé"), "<i4").tolist() == [256, 0x63, 0xC3, 0xA9]


def test_encode_and_decode_frames(awkward, nothing):
    coded = sentencepieces.encode(awkward, PIECES)
    got = coded.collect()
    assert len(got) == awkward.count() and {r.n_ids for r in got if r.doc_id in (2, 3)} == {0}
    back = sentencepieces.decode(coded.select("doc_id", "ids"), PIECES).where("doc_id IN (1, 5)")
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in awkward.where("doc_id IN (1, 5)").collect()}
    assert sentencepieces.encode(nothing, PIECES).count() == 0


# Token files --------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000])
def test_coder_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 65536, n), np.minimum(r.zipf(1.3, n), 65535), np.zeros(n, np.int64), np.arange(n) % 7):
        data = token_files.pack([1, None], [n, 0], ids.astype(np.int64)) + b"\n"
        ((doc_ids, lengths, back),) = token_files.unpack(data)
        assert back.tolist() == ids.tolist() and lengths.tolist() == [n, 0]


def test_damage_is_found():
    ids = np.arange(3000, dtype=np.int64) % 500
    data = token_files.pack([1], [3000], ids) + b"\n"
    for at in (30, len(data) - 40):
        with pytest.raises(ValueError):
            list(token_files.unpack(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))


def test_predictable_ids_are_coded_in_less():
    r = np.random.default_rng(0)
    phrase = r.integers(0, 49000, 50)
    assert len(token_files.pack([1], [20_000], np.tile(phrase, 400))) < 16_000 < len(token_files.pack([1], [20_000], r.integers(0, 49000, 20_000)))


def test_token_files_against_the_library(spark, awkward, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    docs, start, want = sorted(documents(spark)), 0, {}
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_token_files(spark, DATA).collect()} == want
    odd = token_files.round_trip(awkward, WORDS).orderBy("start").collect()
    assert [r.doc_id for r in odd] == [None, 1, 1, 2, 3, 4, 5, 7, 8] and [r.n_tokens for r in odd if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    assert token_files.round_trip(nothing, WORDS).count() == 0


def test_chunks_never_change_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    r = random.Random(4)
    letters = "abEÉ \n\t<|endoftext|>é漢🙂ñ.,!12'ß\u0301\x0b\x00'll ΣİÅ«»…_-"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(4000)] + ["a<|endoftext|>b", "don't.", "x..y!!z_1"]
    for t, coded in zip(texts, token_files.encode_texts([t.encode() for t in texts], WORDS, 1), strict=True):
        assert np.frombuffer(coded, "<u2").tolist() == [*library.encode(t, add_special_tokens=False).ids, 1], t


# Language models and the classifier ---------------------------------------------------------------------------------
def test_lm_of_awkward_tables(awkward, nothing):
    assert lm_scoring.score(awkward, awkward.where("doc_id = 1")).count() == awkward.count()
    assert lm_scoring.score(nothing, nothing).count() == 0
    assert {r.score for r in lm_scoring.score(awkward, nothing).where("doc_id IN (2, 3)").collect()} == {0.0}


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op10_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)


def test_classifier_of_awkward_tables(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (7, 0), (8, 0), (8, 1), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality_classifier.classify(awkward, labels, bits=12).collect()
    assert len(got) == awkward.count() and len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert {r.score for r in quality_classifier.classify(awkward, labels.where("false"), bits=12).collect()} == {0.5}
    assert quality_classifier.classify(nothing, labels, bits=12).count() == 0


def test_ftrl_ignores_forbidden_inputs(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (7, 0)], "doc_id long, quality int")
    one = {r.doc_id: r.score for r in quality_classifier.classify(awkward, labels, bits=12).collect()}
    other = {r.doc_id: r.score for r in quality_classifier.classify(awkward.withColumns({"lang": F.lit("zz"), "source": F.lit("q")}), labels, bits=12).collect()}
    assert one == other


def test_awkward_tables_everywhere(awkward, nothing):
    n = awkward.count()
    for f in (quality_rules.score, line_dedup.digests, simhash.group):
        assert f(awkward).count() == n and f(nothing).count() == 0, f
    for f in (quality_rules.clean, line_dedup.dedup, simhash.dedup):
        assert f(awkward).columns == awkward.columns and f(nothing).count() == 0, f
    assert {r.fingerprint for r in simhash.group(awkward).where("doc_id IN (2, 3, 4)").collect()} == {"0" * 16}
    assert {r.component_id for r in simhash.group(awkward).where("doc_id IN (2, 3, 4)").collect()} == {2}
