"""Mixing sources to target weights by Pfair scheduling, all in DataFrame functions.

Each source's documents, in the order of a hash of their ids, form blocks of ``block``. The weights are rounded to whole
blocks a cycle of about ``slots`` blocks (at least one each). In the fluid schedule all sources that have blocks left
advance at their weights, those left take over the share of one that has run out, and nothing is dropped. Every block
has a window in this schedule: it is released in the slot where the fluid schedule begins it and due at the end of the
slot in which it would finish it. Earliest deadline first over these windows (ties: the first source by name) puts one
block in each slot. Unit jobs with windows from a fluid schedule can all be kept, and earliest deadline first keeps
them, so at every slot each source is less than one block ahead of or behind its due.

How it scales: cycles with the same number of blocks of each source have the same schedule, and these numbers change only
where a source runs out, so at most 2 x sources + 1 cycles of about ``slots`` slots are scheduled, one row each, whatever
the number of documents. A document's number within its source comes from counts of hash prefixes (of bounded size each)
and a window within a prefix, so a source with a third of all documents is spread over as many tasks as it needs. The
schedule, (2 x sources + 1) x (slots + sources) rows, is broadcast if there are at most 256 sources.

Defined results: a null source is a source of its own; sources without a given weight have ``default_weight``; weights
that are not positive count as the smallest share; a null id hashes like an empty text; repeated rows are all placed;
other columns pass through; an empty table gives an empty result. ``position`` ascends in the order of the mixture and
has gaps where a source's last block isn't full.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

_NONE = "\x00"
_PREFIX = 1_000


def _weight(weights: Mapping[str, float] | None, power: float, default: float) -> Column:
    if weights is None:
        return F.pow(F.col("n").cast("double"), F.lit(float(power)))
    given = F.lit(float(default))
    for name, w in weights.items():
        given = F.when(F.col("src") == F.lit(name), F.lit(float(w))).otherwise(given)
    return F.greatest(given, F.lit(0.0))


def _integers(n: Column) -> Column:
    """0 to n - 1, none if n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def plan(counts: DataFrame, weights: Mapping[str, float] | None, power: float, default_weight: float, block: int, slots: int) -> DataFrame:
    """One row per kind of cycle: first cycle ``c0``, sources ``src`` (name, k a cycle), blocks ``b`` of each, ``base`` slot and length ``size``. counts: (src, n)."""
    weighted = counts.withColumn("w", _weight(weights, power, default_weight))
    gathered = weighted.agg(F.array_sort(F.collect_list(F.struct("src", "n", "w"))).alias("s"), F.sum("w").alias("total"))
    k = lambda x: F.greatest(F.lit(1).cast("long"), F.coalesce(F.round(F.lit(float(slots)) * x["w"] / F.nullif(F.col("total"), F.lit(0.0))), F.lit(1.0)).cast("long"))
    blocks = lambda x: F.floor((x["n"] + (block - 1)) / block).cast("long")
    one = gathered.select(F.transform("s", lambda x: F.struct(x["src"].alias("name"), k(x).alias("k"), blocks(x).alias("nb"))).alias("src"))
    full = lambda x: F.floor(x["nb"] / x["k"]).cast("long")
    changes = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.transform("src", full), F.transform("src", lambda x: full(x) + 1))))
    kinds = one.withColumn("starts", changes).select("src", "starts", F.posexplode("starts").alias("kind", "c0"))
    left = lambda x: F.greatest(F.least(x["nb"] - F.col("c0") * x["k"], x["k"]), F.lit(0).cast("long"))
    kinds = kinds.withColumn("b", F.transform("src", left)).withColumn("size", _sum(F.col("b"))).where("size > 0")
    placed = lambda x: F.least(x["nb"], F.col("c0") * x["k"])  # noqa: E731  (whole cycles come before c0)
    # written (a few rows), as expressions over arrays are else computed anew for each of their uses
    return saved(kinds.withColumn("base", _sum(F.transform("src", placed))), "cycles")


def schedule(kinds: DataFrame) -> DataFrame:
    """(kind, c0, base, size, name, k, j, slot): where the j-th block of a source stands in a cycle of this kind."""
    src, b = F.col("src"), F.col("b")

    def fluid(i: Column, j: Column) -> Column:
        """k_i times the fluid schedule's time when source i has done j of its blocks."""
        done = F.transform(src, lambda x, r: F.least(b[r.cast("int")] * src[i.cast("int")]["k"], x["k"] * j))
        return _sum(done)

    n = F.size("src").cast("long")
    per = lambda f: F.transform(_integers(n), lambda i: F.transform(_integers(b[i.cast("int")]), lambda j: f(i, j)))
    windows = kinds.repartition(kinds.count() or 1, "kind").withColumn("release", per(lambda i, j: F.floor(fluid(i, j) / src[i.cast("int")]["k"]).cast("long"))).withColumn(
        "due", per(lambda i, j: F.ceil(fluid(i, j + 1) / src[i.cast("int")]["k"]).cast("long"))
    )

    windows = saved(windows, "windows")

    def step(state: Column, t: Column) -> Column:
        next_ = state["next"]

        def ready(i: Column) -> Column:
            at = i.cast("int")
            j = next_[at].cast("int")
            waiting = F.when(j < b[at], F.when(F.get(F.col("release")[at], j) <= t, F.get(F.col("due")[at], j)))
            return F.when(waiting.isNotNull(), F.struct(waiting.alias("due"), i.alias("i")))

        pick = F.array_min(F.transform(_integers(n), ready))["i"]
        return F.transform(
            F.array(pick),
            lambda p: F.struct(F.transform(next_, lambda x, i: F.when(i == p, x + 1).otherwise(x)).alias("next"), F.concat(state["order"], F.array(p)).alias("order")),
        )[0]

    begin = F.struct(F.transform(src, lambda x: F.lit(0).cast("long")).alias("next"), F.array().cast("array<bigint>").alias("order"))
    ordered = windows.withColumn("order", F.aggregate(_integers(F.col("size")), begin, step, lambda s: s["order"]))
    rows = saved(ordered, "orders").select("kind", "c0", "base", "size", "src", F.posexplode("order").alias("slot", "i"))
    rows = rows.select("kind", "c0", "base", "size", "slot", F.col("src")[F.col("i").cast("int")]["name"].alias("name"), F.col("src")[F.col("i").cast("int")]["k"].alias("k"))
    return rows.withColumn("j", F.row_number().over(Window.partitionBy("kind", "name").orderBy("slot")) - 1)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, default_weight: float = 1.0, block: int = 16, slots: int = 500, source_col: str = "source", id_col: str = "doc_id", position: str = "position") -> DataFrame:
    """docs with ``position``, partitioned and sorted by it. Without weights a source's weight is its count to the power."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keyed = docs.withColumn("__gl_src", F.coalesce(F.col(source_col).cast("string"), F.lit(_NONE))).withColumn("__gl_h", digest)
    counts = keyed.groupBy(F.col("__gl_src").alias("src")).agg(F.count(F.lit(1)).alias("n"))
    total, most, sources = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    digits = 0
    while most > _PREFIX * 16**digits:
        digits += 1
    keyed = keyed.withColumn("__gl_p", F.substring("__gl_h", 1, digits))
    prefixes = keyed.groupBy("__gl_src", "__gl_p").agg(F.count(F.lit(1)).alias("__gl_n"))
    before = Window.partitionBy("__gl_src").orderBy("__gl_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = prefixes.select("__gl_src", "__gl_p", F.coalesce(F.sum("__gl_n").over(before), F.lit(0)).alias("__gl_before"))
    within = F.row_number().over(Window.partitionBy("__gl_src", "__gl_p").orderBy("__gl_h", F.col(id_col).asc_nulls_first())) - 1
    ranked = keyed.withColumn("__gl_i", within).join(offsets, ["__gl_src", "__gl_p"]).withColumn("__gl_i", F.col("__gl_i") + F.col("__gl_before"))
    kinds = plan(counts, weights, power, default_weight, block, slots)
    slot = schedule(kinds).select(
        F.col("name").alias("__gl_src"), F.col("kind").alias("__gl_kind"), F.col("j").cast("long").alias("__gl_j"), F.col("slot").alias("__gl_slot"),
        F.col("c0").alias("__gl_c0"), F.col("base").alias("__gl_base"), F.col("size").alias("__gl_size"),
    )
    rates = kinds.where("kind = 0").select(F.explode("src").alias("x"), "starts").select(F.col("x.name").alias("__gl_src"), F.col("x.k").alias("__gl_k"), F.col("starts").alias("__gl_starts"))
    small = F.broadcast if sources <= 256 else (lambda df: df)
    q = F.floor(F.col("__gl_i") / block).cast("long")
    cycle = F.floor(F.col("__gl_q") / F.col("__gl_k")).cast("long")
    located = ranked.join(small(rates), "__gl_src").withColumn("__gl_q", q).withColumn("__gl_c", cycle)
    located = located.withColumn("__gl_j", F.col("__gl_q") - F.col("__gl_c") * F.col("__gl_k"))
    located = located.withColumn("__gl_kind", F.size(F.filter("__gl_starts", lambda s: s <= F.col("__gl_c"))) - 1)
    slot_number = F.col("__gl_base") + (F.col("__gl_c") - F.col("__gl_c0")) * F.col("__gl_size") + F.col("__gl_slot")
    placed = located.join(small(slot), ["__gl_src", "__gl_kind", "__gl_j"]).withColumn(position, slot_number * block + F.pmod(F.col("__gl_i"), F.lit(block)))
    placed = placed.select(*[c for c in docs.columns if c != position], position)
    # positions are dense, so equal ranges of them are equal parts
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = total + sources * block
    part = F.least(F.floor(F.col(position) * parts / F.lit(max(1, last))), F.lit(parts - 1)).cast("int")
    return placed.repartitionById(parts, part).sortWithinPartitions(position)
