"""Top-k search, the URL filter, the pipeline, oracles and the registry."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries, registry, sql, url_filter, vafile

DATA = "/root/testdata/sf0.001"


def brute_top(rows, k):
    out = {}
    for q, a in rows:
        if q % 3 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in rows if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("bits,block,query_block", [(1, 7, 3), (4, 1000, 1000), (3, 16, 5)])
def test_top_k_against_brute_force(spark, bits, block, query_block):
    r = random.Random(bits)
    rows = [(i, [math.floor(64 * x) for x in (r.choice([-1, 0, 0.5, 1, r.uniform(-2, 2)]) for _ in range(5))]) for i in range(60)]
    df = spark.createDataFrame([(i, [x / 64 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = {}
    for x in vafile.top_k(df, F.col("id") % 3 == 0, 4, 64, bits, block, query_block).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert got == brute_top(rows, 4)


def test_bounds_hold_the_scores():
    r = np.random.default_rng(1)
    exact, q = r.integers(-500, 500, (50, 8)), r.integers(-500, 500, (9, 8))
    low, high = vafile.Approximation(exact, 3).bounds(q)
    assert (low <= q @ exact.T).all() and (q @ exact.T <= high).all()


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, []), (7, []), (8, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    got = vafile.top_k(df, F.col("id") == 0, 20).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 8), (2, 6), (3, 7), (4, 7)]  # every row is a candidate
    assert got[0].score == (2**63 - 1 if got[0].rank == 1 else got[0].score)
    assert vafile.top_k(df.where("false"), F.col("id") == 0).count() == 0


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_rule(host, path):
    best = None
    for rule in (*queries.URL_ALLOW, *queries.URL_BLOCK):
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best)):
            best = rule
    return best


URLS = [
    "https://A.Example.NET/en/1?x=/de/", "http://example.net", "https://b.net/", "http://notexample.com/de/1", "http://w.example.com/de/", "http://x.org/fr/2#a", "http://x.org/frost", "no scheme.net/", None, "", "https://É.Org/fr/", "a://b://c.net/",
    "http://y.com/q", "http://y.com/q", "https://z.org/en/5", "https://z.com:8080?x#y",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.judge(df, queries.URL_ALLOW, queries.URL_BLOCK).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = brute_url(url)
        rule = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict in ("allow", "block")
        if rule:
            assert got[i].verdict == ("allow" if rule in queries.URL_ALLOW else "block")
    assert url_filter.judge(df.where("false"), queries.URL_ALLOW, queries.URL_BLOCK).count() == 0


def brute_model(counts, order):
    """log ratios of all grams from nested dictionaries."""
    chars = len({g[order] for g in counts})

    def p(side, gram):
        below = 1 / chars if len(gram) == 1 else p(side, gram[1:])
        k = len(gram) - 1
        off = order - k
        follow = {}
        for g, c in counts.items():
            if g[off : off + k] == gram[:k]:
                follow[g[off + k]] = follow.get(g[off + k], 0) + c[side]
        n, t = sum(follow.values()), sum(c > 0 for c in follow.values())
        return (follow.get(gram[-1], 0) + t * below) / (n + t) if n + t else below

    return {g: round((math.log(p(0, g)) - math.log(p(1, g))) * url_filter.UNIT) for g in counts}


def test_markov_model_against_brute_force(spark):
    counts = {"aab": (3, 0), "aba": (1, 2), "baa": (0, 4), "bab": (2, 2), "bbb": (0, 0)}
    df = spark.createDataFrame([(g, a, b) for g, (a, b) in counts.items()], "gram string, a long, b long")
    got = {r.gram: r.ratio for r in url_filter._model(df, 2).collect()}
    want = brute_model(counts, 2)
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) <= 2 for g in want)


def test_similar_urls_share_a_verdict(spark):
    rows = [(i, f"https://good{i % 7}.example.net/en/{i}") for i in range(60)] + [(100 + i, f"https://spam{i % 5}.example.com/de/{i}") for i in range(60)] + [(900, "https://good3.host.io/en/5"), (901, "https://spam3.example.com/es/7")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_ALLOW, queries.URL_BLOCK).collect()}
    assert (got[900], got[901]) == ("allow", "block")


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = registry.queries()[name](spark, DATA), con.sql(sql.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(df.select(*columns).collect()) == order(want.select(*columns).fetchall())


def test_registry_has_the_ten():
    assert [sum(n.startswith(f"op{k}_") for n in registry.queries()) for k in range(1, 11)] == [1] * 10


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    import sentencepiece

    from graphloom.llm import quality_rules

    from .test_text_operators import PIECES, brute_components, brute_fingerprint, documents

    docs = []
    for i, t in documents(spark):
        found = quality_rules.judge((t or "").encode(), quality_rules.LineRules())
        if found[6]:
            docs.append((i, t if found[9] is None else found[9].decode()))
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(blank))
    count: dict[str, int] = {}
    for _, t in docs:
        for k in {key(x) for x in t.split("\n")}:
            count[k] = count.get(k, 0) + 1
    docs = [(i, "\n".join(x for x in t.split("\n") if not key(x) or count[key(x)] < 10)) for i, t in docs]
    prints = {i: brute_fingerprint(t) for i, t in docs}
    roots, least = brute_components(prints.values()), {}
    for i, f in prints.items():
        least[roots[f]] = min(least.get(roots[f], i), i)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {i: library.encode(t) for i, t in docs if i in least.values()}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id: list(r.ids) for r in got} == want
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_pipeline_returns_the_order_of_the_mixture(spark):
    import corpus_pipeline

    from graphloom.llm import mixing

    got = corpus_pipeline.run(spark, DATA).orderBy("position").collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").join(spark.createDataFrame([(r.doc_id,) for r in got], "doc_id long"), "doc_id")
    want = mixing.mix(docs, power=0.5, block=16, slots=500).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(got)))
    assert [r.doc_id for r in got] == [r.doc_id for r in want]


def test_places_follow_part_files(spark, tmp_path):
    import corpus_pipeline

    rows = spark.range(100).repartitionByRange(5, F.col("id").desc()).sortWithinPartitions(F.col("id").desc())
    rows.write.option("maxRecordsPerFile", 7).parquet(str(tmp_path / "rows"))
    got = corpus_pipeline.placed(spark.read.parquet(str(tmp_path / "rows"))).orderBy("position").collect()
    assert [(r.position, r.id) for r in got] == [(i, 99 - i) for i in range(100)]


def test_stages_keep_the_columns(spark, awkward, nothing):
    import corpus_pipeline

    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns, name
            out.count()


def test_hot_grams_and_very_long_urls(spark, monkeypatch):
    from graphloom.llm import common

    rows = [(i, f"https://good{i % 7}.example.net/en/{i}") for i in range(40)] + [(100 + i, f"https://spam{i % 5}.example.com/de/{i}") for i in range(40)] + [(900, "https://good3.host.io/en/5"), (901, "https://x.io/" + "spam/de/" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    want = {r.page_id: r.verdict for r in url_filter.judge(df, queries.URL_ALLOW, queries.URL_BLOCK).collect()}
    monkeypatch.setattr(common, "_FEW", 2)
    monkeypatch.setattr(common, "_HOT", 50)
    assert {r.page_id: r.verdict for r in url_filter.judge(df, queries.URL_ALLOW, queries.URL_BLOCK).collect()} == want
    assert len(want) == 82 and (want[900], want[901]) == ("allow", "block")
