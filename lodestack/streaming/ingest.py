"""Structured Streaming ingestion: every micro-batch becomes one generation, and replays change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.versions import group_requests, latest
from lodestack.plans.index import Index
from lodestack.sources.ingest import parse_ops

#: Where a line came from, in the order of arrival: when its file was written, which it is, and where in it a task began to read.
ARRIVAL = ("file_modification_time", "file_path", "file_block_start")


def arrivals(lines: DataFrame, column: str = "value") -> DataFrame:
    """A stream of files' lines with ``arrival``, their place in the order of arrival (but for the lines of one task, which stay in order)."""
    return lines.select(F.col(column).alias("value"), F.struct(*[F.col(f"_metadata.{c}").alias(c) for c in ARRIVAL]).alias("arrival"))


def ingest_batch(index: Index, lines: DataFrame, batch_id: int, failures: str | None = None) -> None:
    """Apply a micro-batch of lines (value, and arrival or seq): the operation of each id that arrived last wins, be it a deletion.

    With ``failures``, a folder, invalid lines are written there, one table per batch, and the others are applied; without it
    one invalid line refuses the whole batch, as apply() does.
    """
    order = [c for c in ("seq", "arrival") if c in lines.columns]
    placed = lines.select("value", *order, F.monotonically_increasing_id().alias("_n"))
    ops = parse_ops(placed)
    if failures is not None:
        ops.where("error is not null").select("value", "error", *order).write.mode("overwrite").json(f"{failures}/batch={batch_id}")
        ops = ops.where("error is null")
    # an invalid line has its own key, so that none hides another
    keyed = ops.withColumn("_k", F.when(F.col("error").isNull(), F.struct("id", F.lit(None).cast("long").alias("n"))).otherwise(F.struct(F.lit(None).cast("string").alias("id"), F.col("_n").alias("n"))))
    last = latest(keyed, "_k", order=(*order, "_n"))
    index.apply(last.drop("_k", "_n", *order), batch_id)


def stream_ingest(lines: DataFrame, index: Index, checkpoint: str, column: str = "value", failures: str | None = None):
    """Start a query that applies a stream of NDJSON lines (files of text, or with a column ``seq``) to the index, with whatever is there now."""
    shown = lines.select(F.col(column).alias("value"), "seq") if "seq" in lines.columns else arrivals(lines, column)
    return shown.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: ingest_batch(index, df, i, failures)).trigger(availableNow=True).start()


def apply_requests(index: Index, ops: DataFrame, most: int = 10_000) -> dict[int, str | int]:
    """Apply the requests of one trigger (rows with ``request``, its number, and an operation each), in order, as few generations: the generation of each request, or its error.

    Requests are grouped while no id repeats and no group passes ``most`` operations; if a group of several is refused, its requests are tried singly.
    """
    asked = ops.groupBy("request").agg(F.collect_list("id").alias("ids")).orderBy("request").collect()  # the requests of one trigger
    groups = group_requests([(r["request"], r["ids"]) for r in asked], most)
    done: dict[int, str | int] = {}
    for group in groups:
        for part in [group] if len(group) == 1 else [group, *[[r] for r in group]]:
            if all(r in done for r in part):
                break
            try:
                g = index.apply(ops.where(F.col("request").isin(part)).drop("request")).generation
                done |= dict.fromkeys(part, g)
            except ValueError as e:
                if len(part) == 1:
                    done[part[0]] = str(e)
    return done
