"""URL filter: rules first, then a ratio of two character language models, all in DataFrame functions.

Rules ``host/path`` fit their host and all its subdomains where the url's path starts with theirs; the longest wins and
gives the verdict. What no rule fits is judged by two smoothed variable-order Markov models, one of the urls that rules
allow and one of those that they block. The probability of a character after a context of ``order`` characters is
interpolated down to the uniform one (Witten-Bell):

    p_k(c | ctx) = (n(ctx c) + t(ctx) p_{k-1}(c | shorter ctx)) / (n(ctx) + t(ctx))

n counts occurrences and t distinct followers. A url's score is the mean of log p_allow - log p_block over its
characters (and an end mark); it is allowed if the score reaches a calibrated threshold: the point between the mean
scores of held-out allowed and blocked urls (one url in ``folds``, chosen by hash, which the models haven't seen) that
lies in proportion to their deviations. Without held-out urls of both kinds the threshold is 0; where rules give no urls
of one kind, everything else is allowed.

How it scales: urls are made distinct first, so a hot url or host is one row or few; counts are map-side combined over
(context, character) and written once; back-off tables come from the longest grams by further grouping, each written
before the next; scores come from one join of the urls' grams, for which grams with over 1/2000 of all characters are
sent to the workers, as is the verdict of a url with over 1/2000 of all rows. Log ratios are rounded to 1e-9 and summed
as integers, so results don't depend on the order of rows.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by its characters like any
other (null: as an empty text); repeated rows all get their verdict; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import met, saved

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"
UNIT = 1_000_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    has = F.instr(u, "://") > 0
    rest = F.when(has, F.expr("substring(coalesce({0}, ''), instr(coalesce({0}, ''), '://') + 3)".format("__gl_url")))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, allow: Sequence[str], block: Sequence[str]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does; of equal rules the blocking one wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ranked = sorted([(len(r), 1, r, "block") for r in block] + [(len(r), 0, r, "allow") for r in allow])
    for _, _, r, v in ranked:  # later ones take precedence
        name, slash, rest = r.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """One row per character: its gram of order + 1 characters, padded with start marks, ended by an end mark, and all
    columns but ``url``: what a row carries doesn't grow with its url."""
    letters = F.split(F.concat(F.lit(START * order), F.coalesce("url", F.lit("")), F.lit(END)), "")
    # a column of its own (used several times, so it isn't folded into the next expression): split once a url
    split = urls.withColumn("__gl_letters", letters).drop("url")
    gram = lambda i: F.concat(*(F.get("__gl_letters", i + k) for k in range(order + 1)))
    grams = F.transform(F.sequence(F.lit(0), F.size("__gl_letters") - order - 1), gram)
    return split.select(*(c for c in urls.columns if c != "url"), F.explode(grams).alias("gram"))


def _model(counts: DataFrame, order: int) -> DataFrame:
    """(gram, ratio): log p_allow - log p_block of every gram, in UNITs. counts: (gram, a, b)."""
    level = counts
    chars = counts.select(F.substring("gram", order + 1, 1).alias("c")).distinct().count()
    tables = []
    for k in range(order, -1, -1):  # level has grams of k + 1 characters
        context = level.groupBy(F.substring("gram", 1, k).alias("ctx")).agg(
            F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum((F.col("b") > 0).cast("long")).alias("tb")
        )
        tables.append(level.withColumn("ctx", F.substring("gram", 1, k)).join(context, "ctx"))
        if k:
            level = saved(level.groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "shorter-grams")
    flat = F.lit(1.0 / max(1, chars))

    def mixed(x: str, below: Column) -> Column:
        n, t = F.col(f"n{x}"), F.col(f"t{x}")
        return F.when(n + t > 0, (F.col(x) + t * below) / (n + t)).otherwise(below)

    probs = tables[-1].select("gram", mixed("a", flat).alias("pa"), mixed("b", flat).alias("pb"))
    for k in range(1, order + 1):
        lower = probs.select(F.col("gram").alias("short"), F.col("pa").alias("la"), F.col("pb").alias("lb"))
        at = tables[order - k].withColumn("short", F.substring("gram", 2, k))
        probs = saved(at.join(lower, "short").select("gram", mixed("a", F.col("la")).alias("pa"), mixed("b", F.col("lb")).alias("pb")), "probabilities")
    return probs.select("gram", F.round((F.log("pa") - F.log("pb")) * UNIT).cast("long").alias("ratio"))


def judge(pages: DataFrame, allow: Sequence[str], block: Sequence[str], order: int = 4, folds: int = 5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    rows = pages.select(id_col, F.coalesce(F.col(url_col), F.lit(START)).alias("key"), F.col(url_col).alias("__gl_url"))
    urls = rows.groupBy("key").agg(F.first("__gl_url").alias("__gl_url"), F.count(F.lit(1)).alias("n"))
    host, path = host_and_path(F.col("__gl_url"))
    urls = urls.select("key", "__gl_url", "n", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), allow, block)
    # written with a number, which stands for the url wherever its grams are counted
    urls = saved(urls.select(F.monotonically_increasing_id().alias("number"), "key", "__gl_url", "n", "host", "path", rule.alias("rule"), verdict.alias("said")), "urls")
    held = F.conv(F.substring(F.md5(F.coalesce("__gl_url", F.lit(""))), 1, 7), 16, 10).cast("long") % folds == 0
    # the model reads urls without their scheme: it says nothing about them
    bare = F.expr("substring(__gl_url, instr(__gl_url, '://') + if(instr(__gl_url, '://') > 0, 3, 1))")
    known = urls.select("number", "said", (F.col("said").isNotNull() & held).alias("held"), bare.alias("url"))
    grams = _grams(known, order)
    learn = F.col("said").isNotNull() & ~F.col("held")
    counts = saved(grams.groupBy("gram").agg(F.count_if(learn & (F.col("said") == "allow")).alias("a"), F.count_if(learn & (F.col("said") == "block")).alias("b"), F.count(F.lit(1)).alias("n")), "url-grams")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model = saved(_model(counts.select("gram", "a", "b"), order).join(counts.select("gram", "n"), "gram"), "gram-ratios")
    judged = met(grams.where("said IS NULL OR held"), model, "gram", total)
    scores = saved(judged.groupBy("number", "said").agg((F.sum("ratio") / F.count(F.lit(1))).alias("score")), "url-scores")
    fit = scores.agg(
        *(F.avg(F.when(F.col("said") == v, F.col("score"))).alias(f"m{x}") for v, x in (("allow", "a"), ("block", "b"))),
        *(F.stddev_pop(F.when(F.col("said") == v, F.col("score"))).alias(f"s{x}") for v, x in (("allow", "a"), ("block", "b"))),
    )
    both = known.where(learn).agg(F.max((F.col("said") == "allow").cast("int")).alias("seen_a"), F.max((F.col("said") == "block").cast("int")).alias("seen_b"))
    limit = fit.crossJoin(both).select(
        (F.coalesce("seen_a", F.lit(0)) + F.coalesce("seen_b", F.lit(0)) < 2).alias("untrained"),
        F.round(F.coalesce(F.when(F.col("sa") + F.col("sb") > 0, (F.col("ma") * F.col("sb") + F.col("mb") * F.col("sa")) / (F.col("sa") + F.col("sb"))), (F.col("ma") + F.col("mb")) / 2, F.lit(0.0))).alias("threshold"),
    )
    limit = F.broadcast(limit)  # one row
    guessed = scores.where("said IS NULL").crossJoin(limit).select("number", F.when(F.col("untrained") | (F.col("score") >= F.col("threshold")), "allow").otherwise("block").alias("guess"))
    done = saved(urls.join(guessed, "number", "left").select("key", "host", "path", "rule", F.coalesce("said", "guess").alias("verdict"), "n"), "verdicts")
    count = done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return met(rows.select(id_col, "key"), done, "key", count).select(id_col, "host", "path", "rule", "verdict")
