"""Graph operators: neighbours, traversals, shortest paths, ranking, components, closures.

Edges are (source_id, target_id, ...); any target may be missing among the nodes and edges may repeat. A loop's state is
written at every step, its frontier holds only vertices whose state has changed, and joins are plain equi-joins whose
strategy adaptive execution picks from the frontier's measured size.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.taxonomy import ANCHOR_KINDS, ANCHOR_LABELS, ENTRY_FILES, ENTRY_NAMES
from ..plans.loops import forget, written

# What a step over an edge costs when impact or a path is measured.
IMPACT_WEIGHTS = {"EXTENDS": 0.5, "IMPLEMENTS": 0.7, "CALLS": 1.0, "CONSTRUCTS": 1.2, "MEMBER_OF": 1.5, "IMPORTS": 2.0, "DEPENDS_ON": 2.5}
PATH_WEIGHTS = {"EXTENDS": 0.1, "IMPLEMENTS": 0.2, "CALLS": 1.0, "MEMBER_OF": 1.2, "IMPORTS": 1.5, "DEPENDS_ON": 2.0}


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b): one step leads from a to b."""
    if direction not in ("upstream", "downstream"):
        raise ValueError(direction)
    a, b = ("source_id", "target_id") if direction == "downstream" else ("target_id", "source_id")
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b"), *(c for c in ("type", "id", "weight", "confidence") if c in edges.columns))


def neighbours(edges: DataFrame, node: str, direction: str = "downstream", edge_type: str | None = None) -> DataFrame:
    """GR-01: edges out of or into a node, of one type if asked."""
    out = edges.where(F.col("source_id" if direction == "downstream" else "target_id") == node)
    return out if edge_type is None else out.where(F.col("type") == edge_type)


def file_neighbours(nodes: DataFrame, edges: DataFrame, file: str, direction: str = "downstream") -> DataFrame:
    """GR-02: edges that cross a file's border, with the file on the other side."""
    own = nodes.select("id", "file")
    both = edges.join(own.select(F.col("id").alias("source_id"), F.col("file").alias("source_file")), "source_id").join(own.select(F.col("id").alias("target_id"), F.col("file").alias("target_file")), "target_id")
    here, there = ("source_file", "target_file") if direction == "downstream" else ("target_file", "source_file")
    return both.where((F.col(here) == file) & (F.col(there) != file))


def degrees(edges: DataFrame) -> DataFrame:
    """AGG-11: (id, in_degree, out_degree, degree) of every end of an edge, multi-edges counted."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    rolled = ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return rolled.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-12: one row: node_count, edge_count, upper median out-degree over nodes with out-edges, density."""
    out = edges.groupBy("source_id").agg(F.count(F.lit(1)).alias("d"))
    # the histogram of degrees is small: as many rows as there are different degrees
    spread = out.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    upto = spread.withColumn("upto", F.sum("n").over(Window.orderBy("d"))).crossJoin(F.broadcast(out.agg(F.count(F.lit(1)).alias("total"))))
    median = upto.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("d").alias("m"))
    one = nodes.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edge_count"))).crossJoin(median)
    density = F.coalesce(F.try_divide(F.col("edge_count"), F.col("node_count")), F.lit(0.0))
    return one.select("node_count", "edge_count", F.coalesce("m", F.lit(0)).alias("median_degree"), F.round(density, 6).alias("density"))


def bfs(edges: DataFrame, start: str | DataFrame, direction: str = "upstream", max_depth: int = 5, types: Sequence[str] | None = None, include_start: bool | None = True) -> DataFrame:
    """GR-07, GR-11, GR-13, GR-33: (id, depth) of what is reached within max_depth steps.

    start: an id or a DataFrame with column id. include_start None keeps it only if a step leads back to it, as its
    distance on the way around.
    """
    spark = edges.sparkSession
    steps = _steps(edges if types is None else edges.where(F.col("type").isin(*types)), direction).select("a", "b").distinct()
    first = spark.createDataFrame([(start,)], "id string") if isinstance(start, str) else start.select("id").distinct()
    seen = written(first.withColumn("depth", F.lit(0)))
    frontier = seen
    parts = [seen] if include_start else []
    known = seen if include_start is not None else None
    for depth in range(1, max_depth + 1):
        reached = frontier.select(F.col("id").alias("a")).join(steps, "a").select(F.col("b").alias("id")).distinct()
        if known is not None:
            reached = reached.join(known.select("id"), "id", "left_anti")
        frontier = written(reached.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        parts.append(frontier)
        known = frontier if known is None else known.unionByName(frontier)
    whole = parts[0] if parts else seen.limit(0)
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select("id", F.col("depth").cast("int").alias("depth"))


def closure(edges: DataFrame, starts: DataFrame, direction: str = "downstream", max_depth: int = 10, types: Sequence[str] | None = None) -> DataFrame:
    """GR-16, GR-26: (root, id, depth): what each start reaches, itself included at depth 0."""
    steps = written(_steps(edges if types is None else edges.where(F.col("type").isin(*types)), direction).select("a", "b").distinct())
    frontier = written(starts.select(F.col("id").alias("root"), "id").distinct().withColumn("depth", F.lit(0)))
    whole = frontier
    for depth in range(1, max_depth + 1):
        reached = frontier.select("root", F.col("id").alias("a")).join(steps, "a").select("root", F.col("b").alias("id")).distinct()
        frontier = written(reached.join(whole.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        whole = whole.unionByName(frontier)
    return whole


def shortest(edges: DataFrame, start: str, direction: str = "downstream", weights: Mapping[str, float] | None = None, max_weight: float = 10.0, default: float = 1.0, cost: Column | None = None) -> DataFrame:
    """GR-08, GR-09, GR-14: (id, weight, path) of all that lies within max_weight, the start excluded.

    Bellman-Ford over the vertices that improved: each keeps its least (weight, path), paths compared as text, so ties
    are settled the same way every time. path lists the ids from the start on.
    """
    spark = edges.sparkSession
    w = F.lit(default)
    for name, value in (weights or {}).items():
        w = F.when(F.col("type") == name, F.lit(float(value))).otherwise(w)
    steps = _steps(edges, direction).select("a", "b", (cost if cost is not None else w).cast("double").alias("w"))
    steps = written(steps.groupBy("a", "b").agg(F.min("w").alias("w")))
    best = written(spark.createDataFrame([(start, 0.0, [start])], "id string, weight double, path array<string>"))
    moved = best
    while True:
        tried = moved.select(F.col("id").alias("a"), "weight", "path").join(steps, "a").select(F.col("b").alias("id"), (F.col("weight") + F.col("w")).alias("weight"), F.concat("path", F.array("b")).alias("path"))
        tried = tried.where(F.col("weight") <= max_weight).groupBy("id").agg(F.min(F.struct("weight", "path")).alias("t"))
        old = best.select("id", F.struct("weight", "path").alias("o"))
        moved = written(tried.join(old, "id", "left").where(F.col("o").isNull() | (F.col("t") < F.col("o"))).select("id", "t.weight", "t.path"))
        if moved.isEmpty():
            break
        best = written(best.join(moved.select("id"), "id", "left_anti").unionByName(moved))
    return best.where(F.col("id") != start)


def impact(edges: DataFrame, start: str, direction: str = "upstream", max_weight: float = 5.0) -> DataFrame:
    """GR-12: (id, distance) of what a change reaches."""
    return shortest(edges, start, direction, IMPACT_WEIGHTS, max_weight).select("id", F.round("weight", 6).alias("distance"))


def impact_score(reached: DataFrame) -> DataFrame:
    """GR-12, AGG-19: one row: affected, score (sum of 1 / distance, two decimals), risk band."""
    rolled = reached.agg(F.count(F.lit(1)).alias("affected"), F.coalesce(F.sum(F.try_divide(F.lit(1.0), F.col("distance"))), F.lit(0.0)).alias("raw"))
    score = F.floor(F.round(F.col("raw"), 9) * 100 + 0.5) / 100
    band = F.when(score < 2, "LOW").when(score < 5, "MEDIUM").when(score < 15, "HIGH").otherwise("CRITICAL")
    return rolled.select("affected", score.alias("score"), band.alias("risk"))


def path(edges: DataFrame, start: str, end: str, max_weight: float = 50.0) -> DataFrame:
    """GR-14: the cheapest path between two nodes: one row (weight, path), none if there is no path."""
    return shortest(edges, start, "downstream", PATH_WEIGHTS, max_weight).where(F.col("id") == end).select(F.round("weight", 6).alias("weight"), "path")


def anchors(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("canonical_kind").isin(*ANCHOR_KINDS) | F.col("semantic_kind").isin(*ANCHOR_LABELS))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 30, damping: float = 0.85, together: int = 6) -> DataFrame:
    """GR-03: (id, rank, energy) of every node: fixed iterations over edges between anchors, multi-edges counted, the mass
    of anchors without out-edges spread evenly; other nodes have 0. energy is rank times the number of anchors.

    The iteration is linear and spreads only the uniform vector, so it is done as y(k + 1) = M y(k) from the uniform y(0):
    one join and one aggregation a step, ``together`` steps written at a time. The mass lost at ends is one number a
    step, known when all steps are; ranks are the steps' sum with the coefficients that follow from it.
    """
    ids = written(anchors(nodes).select("id").distinct())
    n = ids.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"), F.lit(0.0).alias("energy"))
    inner = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    many = inner.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("m"))
    out = many.groupBy("source_id").agg(F.sum("m").alias("d"))
    moves = written(many.join(out, "source_id").select(F.col("source_id").alias("id"), "target_id", (F.col("m") / F.col("d")).alias("p")))
    steps = written(ids.select("id", F.lit(1.0 / n).alias("y"), F.lit(0).alias("k")))
    y = steps.select("id", "y")
    for first in range(1, iterations + 1, together):
        some = []  # each of them reads the last one's exchange, so a step is computed once
        for k in range(first, min(first + together, iterations + 1)):
            y = y.join(moves, "id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("y") * F.col("p")).alias("y"))
            some.append(y.withColumn("k", F.lit(k)))
        made = written(functools.reduce(DataFrame.unionByName, some))
        y = made.where(F.col("k") == first + len(some) - 1).select("id", "y")
        steps = steps.unionByName(made)
    ends = ids.join(moves.select("id"), "id", "left_anti")
    at_ends = dict(steps.join(ends, "id", "left_semi").groupBy("k").agg(F.sum("y")).collect())  # a number for each step
    share = [1.0]  # of each step in the ranks
    for _ in range(iterations):
        lost = sum(c * at_ends.get(k, 0.0) for k, c in enumerate(share))
        share = [1 - damping + damping * lost, *(damping * c for c in share)]
    ranks = steps.join(F.broadcast(nodes.sparkSession.createDataFrame(list(enumerate(share)), "k int, share double")), "k").groupBy("id").agg(F.sum(F.col("y") * F.col("share")).alias("rank"))
    ranked = nodes.select("id").join(ranks, "id", "left")
    return ranked.select("id", F.coalesce("rank", F.lit(0.0)).alias("rank"), (F.coalesce("rank", F.lit(0.0)) * n).alias("energy"))


def energy(edges: DataFrame) -> DataFrame:
    """GR-05: (id, energy, rank): 2 in + out and log10(energy + 1) / 10."""
    e = 2 * F.col("in_degree") + F.col("out_degree")
    return degrees(edges).select("id", e.alias("energy"), F.round(F.log10(e + 1) / 10, 6).alias("rank"))


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-04: nodes with is_entry_point detected; a mark that is already set stays."""
    d = degrees(edges)
    joined = nodes.join(d.select("id", "in_degree", "out_degree"), "id", "left").fillna({"in_degree": 0, "out_degree": 0})
    label = F.coalesce("semantic_kind", F.lit(""))
    base = F.element_at(F.split(F.coalesce("file", F.lit("")), "/"), -1)
    is_root = (F.col("in_degree") == 0) & (F.col("out_degree") > 0) & label.isin("module", "file", "function", "class")
    found = label.contains("route") | is_root | F.lower(F.coalesce("name", F.lit(""))).isin(*ENTRY_NAMES) | base.isin(*ENTRY_FILES) | F.coalesce("is_entry_point", F.lit(False))
    return joined.withColumn("is_entry_point", found).drop("in_degree", "out_degree")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): weakly connected components by alternating star steps; component is the least id."""
    pairs = written(edges.select(F.greatest("source_id", "target_id").alias("u"), F.least("source_id", "target_id").alias("v")).where("u <> v").distinct())
    lone = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        last, pairs = pairs, written(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        forget(last)
        mark = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if mark == before:
            break
        before = mark
    return lone.join(pairs.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _spread_max(steps: DataFrame, state: DataFrame) -> DataFrame:
    """Fixpoint of: a vertex takes the largest colour of itself and of those that lead to it. steps (a, b), state (id, colour)."""
    changed = state
    while True:
        offered = changed.join(steps, changed["id"] == steps["a"]).groupBy("b").agg(F.max("colour").alias("new"))
        better = offered.join(state, offered["b"] == state["id"]).where("new > colour").select("id", F.col("new").alias("colour"))
        better = written(better)
        if better.isEmpty():
            return state
        state = written(state.join(better.select("id", F.col("colour").alias("c2")), "id", "left").select("id", F.coalesce("c2", "colour").alias("colour")))
        changed = better


def _tarjan(a: list[int], b: list[int], n: int) -> list[int]:
    """The largest vertex of each vertex's strongly connected component, vertices 0 to n - 1, edges a to b."""
    follow: list[list[int]] = [[] for _ in range(n)]
    for x, y in zip(a, b, strict=True):
        follow[x].append(y)
    index, low, name = [-1] * n, [0] * n, [-1] * n
    open_: list[int] = []
    count = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        walk = [(root, 0)]
        while walk:
            x, at = walk.pop()
            if at == 0:
                index[x] = low[x] = count
                count += 1
                open_.append(x)
            else:
                low[x] = min(low[x], low[follow[x][at - 1]])
            while at < len(follow[x]):
                y = follow[x][at]
                at += 1
                if index[y] < 0:
                    walk += [(x, at), (y, 0)]
                    break
                if name[y] < 0:
                    low[x] = min(low[x], index[y])
            else:
                if low[x] == index[x]:
                    members = [open_.pop()]
                    while members[-1] != x:
                        members.append(open_.pop())
                    largest = max(members)
                    for y in members:
                        name[y] = largest
    return name


def _strong_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, colour) of the vertices of one task's edges (a, b), which hold whole weak components."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    ids = pc.unique(pa.chunked_array([*whole["a"].chunks, *whole["b"].chunks])).sort()
    a, b = (pc.index_in(whole[c], ids).to_pylist() for c in "ab")
    colours = ids.take(pa.array(_tarjan(a, b, len(ids))))
    yield pa.RecordBatch.from_arrays([ids, colours], names=["id", "colour"])


def strong_components(edges: DataFrame, ignore_types: Sequence[str] = (), most: int = 1_000_000) -> DataFrame:
    """GR-06: (id, component, size) of strongly connected components with more than one node, or one with a self-loop.

    Weakly connected parts of at most ``most`` edges are dealt out whole and searched depth-first, many to a task of
    about as many edges. Larger ones are coloured in rounds (``_coloured``). The component's name is its largest id. The
    self-loop test looks at all edge types.
    """
    loops = edges.where("source_id = target_id").select(F.col("source_id").alias("id")).distinct()
    kept = edges.where(~F.col("type").isin(*ignore_types)) if ignore_types else edges
    steps = kept.where("source_id <> target_id").select("source_id", "target_id").distinct()
    parts = components(steps).select(F.col("id").alias("source_id"), "component")
    steps = written(steps.join(parts, "source_id").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "component"))
    sizes = written(steps.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    total, large = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > most)).first()
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // most))
    small = steps if not large else steps.join(sizes.where(F.col("n") > most), "component", "left_anti")
    found = written(small.repartition(tasks, "component").select("a", "b").mapInArrow(_strong_in_task, "id string, colour string"))
    if large:
        coloured = _coloured(written(steps.join(sizes.where(F.col("n") > most), "component", "left_semi").select("a", "b")))
        found = found if coloured is None else found.unionByName(coloured)
    sizes = found.groupBy("colour").agg(F.count(F.lit(1)).alias("size"))
    alone = loops.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("colour"), F.lit(1).cast("long").alias("size"))
    named = found.join(sizes, "colour").select("id", "colour", "size").unionByName(alone)
    return named.join(loops.withColumn("loop", F.lit(True)), "id", "left").where("size > 1 OR loop").select("id", F.col("colour").alias("component"), "size")


def _coloured(steps: DataFrame) -> DataFrame | None:
    """(id, colour) of the vertices in strongly connected components of edges (a, b); None if there are none.

    Vertices without a way in or out are peeled off; the rest take the largest id that reaches them; a colour's component
    is what reaches its root within the colour, is taken out, and what is left starts over.
    """
    found = None
    while not steps.isEmpty():
        while True:  # peel
            inner = steps.join(steps.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
            inner = written(inner.join(inner.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            done = inner.count() == steps.count()
            steps = inner
            if done or steps.isEmpty():
                break
        if steps.isEmpty():
            break
        ids = steps.select(F.col("a").alias("id")).unionByName(steps.select(F.col("b").alias("id"))).distinct()
        colours = written(_spread_max(steps, written(ids.withColumn("colour", F.col("id")))))
        # backwards from each root, inside its colour
        inside = steps.join(colours.select(F.col("id").alias("a"), F.col("colour").alias("ca")), "a").join(colours.select(F.col("id").alias("b"), F.col("colour").alias("cb")), "b").where("ca = cb").select("a", "b", F.col("ca").alias("colour"))
        inside = written(inside)
        members = written(colours.where("id = colour"))
        frontier = members
        while True:
            back = frontier.select(F.col("id").alias("b"), "colour").join(inside, ["b", "colour"]).select(F.col("a").alias("id"), "colour").distinct()
            frontier = written(back.join(members.select("id"), "id", "left_anti"))
            if frontier.isEmpty():
                break
            members = written(members.unionByName(frontier))
        found = members if found is None else found.unionByName(members)
        left = steps.join(members.select(F.col("id").alias("a")), "a", "left_anti").join(members.select(F.col("id").alias("b")), "b", "left_anti")
        steps = written(left.select("a", "b"))
    return found


def topological_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """SRT-08: (id, level): 0 for what depends on nothing, else one more than its dependencies; the rest (cycles and what
    hangs on them) share the last level. An edge says that its source depends on its target."""
    deps = written(edges.where("source_id <> target_id").select(F.col("source_id").alias("id"), F.col("target_id").alias("dep")).distinct())
    left = deps.select("id").unionByName(deps.select(F.col("dep").alias("id"))).distinct() if nodes is None else nodes.select("id").distinct()
    left = written(left)
    if nodes is not None:
        deps = written(deps.join(left, "id", "left_semi").join(left.select(F.col("id").alias("dep")), "dep", "left_semi").select("id", "dep"))
    level, parts = 0, []
    while not left.isEmpty():
        free = written(left.join(deps.select("id"), "id", "left_anti"))
        if free.isEmpty():
            parts.append(left.withColumn("level", F.lit(level)))
            break
        parts.append(free.withColumn("level", F.lit(level)))
        left = written(left.join(free, "id", "left_anti"))
        deps = written(deps.join(free.select(F.col("id").alias("dep")), "dep", "left_anti").select("id", "dep"))
        level += 1
    whole = parts[0] if parts else left.withColumn("level", F.lit(0))
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def nearest_ancestor(nodes: DataFrame, wanted: Column, max_hops: int = 20, include_self: bool = True) -> DataFrame:
    """GR-31, GR-32: (id, ancestor, hops): the first node for which ``wanted`` holds on the way up the parent pointers;
    ancestor is null where there is none within max_hops or the way ends.

    Only nodes that are parents walk, by pointers that double in length each round, so a parent of most nodes is resolved
    once; all nodes then take their parent's answer in one join. Rows with one id meet each other's answers.
    """
    up = nodes.select("id", "parent_id", F.coalesce(wanted, F.lit(False)).alias("ok"))
    parents = up.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
    inner = up.join(parents, "id", "left_semi")
    # at: where the pointer leads, hops steps up; found: whether that is the answer
    state = written(inner.where("ok OR parent_id IS NOT NULL").select("id", F.when(F.col("ok"), F.col("id")).otherwise(F.col("parent_id")).alias("at"), F.when(F.col("ok"), 0).otherwise(1).alias("hops"), F.col("ok").alias("found")))
    length = 1
    while length < max_hops and not state.where("NOT found").isEmpty():
        ahead = state.select(F.col("id").alias("at"), F.col("at").alias("then"), F.col("hops").alias("more"), F.col("found").alias("there"))
        moved = state.where("NOT found").join(ahead, "at").select("id", F.col("then").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), F.col("there").alias("found"))
        last, state = state, written(state.where("found").unionByName(moved))
        forget(last)
        length *= 2
    answers = state.where("found").select(F.col("id").alias("parent_id"), "at", "hops")
    own = up.withColumn("own", F.col("ok") if include_self else F.lit(False))
    # a node that is its own answer, or has no parent, needs no join; its key is null and never hot
    asked = own.withColumn("parent_id", F.when(~F.col("own"), F.col("parent_id")))
    joined = asked.join(answers, "parent_id", "left")
    joined = joined.where(F.col("own") | (F.col("hops") + 1 <= max_hops))
    whole = joined.select("id", F.when(F.col("own"), F.col("id")).otherwise(F.col("at")).alias("ancestor"), F.when(F.col("own"), 0).otherwise(F.col("hops") + 1).alias("hops"))
    return nodes.select("id").join(whole, "id", "left")


def flow(edges: DataFrame, start: str, max_depth: int = 10) -> DataFrame:
    """GR-15: the steps (source_id, target_id, type, depth) over CALLS and ACCESSES out of all that the start reaches.

    The set of steps is that of a depth-first walk; depth is the least distance of a step's source."""
    types = ("CALLS", "ACCESSES")
    reached = bfs(edges, start, "downstream", max_depth - 1, types)
    own = edges.where(F.col("type").isin(*types)).select("source_id", "target_id", "type").distinct()
    return own.join(reached.select(F.col("id").alias("source_id"), "depth"), "source_id").select("source_id", "target_id", "type", "depth")


def processes(nodes: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """GR-16: (root, size, members): what each node without incoming calls reaches over CALLS and ACCESSES, by root id."""
    called = edges.where("type = 'CALLS'").select(F.col("target_id").alias("id"))
    roots = nodes.select("id").join(called, "id", "left_anti")
    inside = closure(edges, roots, "downstream", max_depth, ("CALLS", "ACCESSES"))
    return inside.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_set("id")).alias("members"))


def test_coverage(nodes: DataFrame, edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """GR-26, AGG-17: (id, covered_by): the test files whose nodes lead to a node that is no test, within max_depth, over nodes that exist."""
    own = edges.join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    tests = nodes.where("is_test").select("id", "file")
    reached = closure(own, tests.select("id"), "downstream", max_depth)
    found = reached.join(tests.select(F.col("id").alias("root"), F.col("file").alias("test_file")), "root").join(nodes.where("NOT coalesce(is_test, false)").select("id"), "id", "left_semi")
    return found.groupBy("id").agg(F.array_sort(F.collect_set("test_file")).alias("covered_by"))
