"""Sums of arrays over all rows: a value for each partition, then a tree of tasks that join some of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.store import given_back, materialise

#: Values that one task joins into one.
FAN = 16


def reduced(rows: DataFrame, take: Callable[[np.ndarray | None, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(part, value): what ``take`` makes of the value so far (None at first) and each batch of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = None
        for batch in batches:
            if batch.num_rows:
                value = take(value, batch)
        if value is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([value.ravel()], pa.list_(pa.float64()))], ["part", "value"])

    return rows.mapInArrow(given_back(run), "part bigint, value array<double>")


def merge_tree(parts: DataFrame, join: Callable[[list[np.ndarray]], np.ndarray], name: str) -> np.ndarray | None:
    """One value from rows (part bigint, value array<double>).

    A task joins FAN neighbouring parts at most, round after round; each round is a table, so a lost
    executor repeats one round.
    """

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        value = join([v.values.to_numpy() for v in table["value"]])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "value": pa.array([value], pa.list_(pa.float64()))})

    parts = materialise(parts, name)
    while parts.count() > 1:
        group = F.floor(F.col("part") / FAN).alias("group")
        parts = materialise(parts.groupBy(group).applyInArrow(merged, "part bigint, value array<double>"), name)
    row = parts.first()
    return np.array(row.value) if row else None


