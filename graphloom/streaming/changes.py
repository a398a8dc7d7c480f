"""Streams of changes: incremental refresh of a store, and windowed counts of an edge stream.

STR-01 and STR-02 are the change stream and what each batch of it does. Watermarks, windows and deduplication are this
engine's own additions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def refresh(store: Store, changes: DataFrame, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str, clock: Callable[[int], int], on_batch: Callable[[int, DataFrame], None] | None = None, time: str | None = None, **trigger) -> StreamingQuery:
    """STR-01, STR-02: each batch of (path, source, change) becomes a snapshot: changed files are extracted anew, all else
    is carried forward. Removed files (change ``unlink``) are left alone, as the watcher does.

    Of several changes of a file in a batch the last by the column ``time`` counts (of equal times the greatest source, so
    that a batch that runs again has the same result); without such a column, the last in the order of the batch's rows.
    The snapshot is named after the batch, so a batch that runs again replaces its own snapshot. clock gives its time.
    """

    when = F.struct(F.col(time), F.col("source")) if time else F.monotonically_increasing_id()

    def step(batch: DataFrame, number: int) -> None:
        files = batch.where("change <> 'unlink'").withColumn("__gl_when", when).groupBy("path").agg(F.max_by("source", "__gl_when").alias("source"))
        if files.isEmpty():
            return
        nodes, edges = extract(files)
        units = files.select(F.concat(F.lower("path"), F.lit("::unit")).alias("unit_id"))
        store.write(f"batch_{number:09d}", clock(number), nodes, edges, replaces=units)
        if on_batch is not None:
            on_batch(number, units)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def edge_counts(edges: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 day", keys: tuple[str, ...] = ("source_id", "target_id", "type")) -> DataFrame:
    """Our addition: edges per window, late ones within the watermark counted."""
    return edges.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("weight")).select(F.col("window.start").alias("window_start"), *keys, "weight")


def distinct_edges(edges: DataFrame, time: str = "ts", late: str = "1 hour", key: str = "id") -> DataFrame:
    """Our addition: an edge that comes again within the watermark is dropped, as adding an edge twice changes nothing."""
    return edges.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
