"""Helpers shared by the operators: free column names, global row numbers, connected components."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kerbline.operators.linked import components  # noqa: F401
from kerbline.session import written

#: What parts words: blanks of ASCII. A word is a run of anything else.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores before it, so that no column of ``df`` has it (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: Sequence[str], label: str, rank: str, running: dict[str, str] | None = None) -> DataFrame:
    """``df`` with its global row number from 0 in ``rank``, in the order of the columns ``order``.

    ``running`` maps a long column (never null) to the name of its sum over all rows before. Rows are dealt by range and
    sorted, each task numbers its own rows, and one row per task carries the offsets; rows alike in ``order`` are dealt by
    their place in the input, so that a run of repeated rows may cross tasks. The result is a written table.
    """
    running = running or {}
    part, tie = free_name(df, "part"), free_name(df, "tie")
    keys = [*order, tie]
    ranged = (df.withColumn(tie, F.monotonically_increasing_id())
              .repartitionByRange(partitions(df), *[column(c) for c in keys]).sortWithinPartitions(*[column(c) for c in keys]).drop(tie))
    schema = T.StructType([*ranged.schema, T.StructField(part, T.LongType()), T.StructField(rank, T.LongType()),
                           *[T.StructField(v, T.LongType()) for v in running.values()]])

    def number(batches):
        at, before = 0, dict.fromkeys(running, 0)
        task = TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            arrays = [*batch.columns, pa.array(np.full(n, task, np.int64)), pa.array(np.arange(at, at + n, dtype=np.int64))]
            for c in running:
                sums = np.cumsum(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64))
                arrays.append(pa.array(np.concatenate([[0], sums[:-1]]).astype(np.int64)[:n] + before[c]))
                before[c] += int(sums[-1]) if n else 0
            at += n
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    table = written(ranged.mapInArrow(number, schema), label)
    totals = table.groupBy(part).agg(F.count("*").alias("n"), *[F.sum(column(c)).alias(f"s{i}") for i, c in enumerate(running)])
    # One row per task of the range shuffle, so the window and the broadcast are of that size.
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                            *[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"s0{i}") for i in range(len(running))])
    base = offsets.select(column(part).alias("__part"), F.col("n0").alias("__n0"), *[F.col(f"s0{i}").alias(f"__s0{i}") for i in range(len(running))])
    joined = table.join(F.broadcast(base), column(part) == F.col("__part"))
    out = joined.withColumn(rank, column(rank) + F.col("__n0"))
    for i, name in enumerate(running.values()):
        out = out.withColumn(name, column(name) + F.col(f"__s0{i}"))
    return out.select(*[column(c) for c in df.columns], column(rank), *[column(v) for v in running.values()])
