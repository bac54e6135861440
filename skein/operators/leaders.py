"""First-match leaders: rows in order join the first leader that they are like, else they lead.

A row's leader depends on which rows before it lead, but not on their followers.  So waves settle the
first undecided rows of all keys: a wave's rows are settled among themselves, and its new leaders are
then compared to all later rows, slice by slice in parallel.  Followers are done with; waves are as many
as a key's leaders fill, however many rows follow them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.stages import stored

#: Rows of a slice, about, and rows that a wave settles of a key, unless its first slice has more.
SLICE, WAVE = 1024, 4096

#: [a, b] whether row a and leader b are alike, of two matrices of fields.
Alike = Callable[[np.ndarray, np.ndarray], np.ndarray]


def dots_at_least(threshold: float) -> Alike:
    return lambda a, b: a @ b.T >= threshold


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def first_leaders(df: DataFrame, *, key: str, order: str, fields: str, alike: Alike) -> DataFrame:
    """(key, order, leader) for each row: the ``order`` of the first leader of its key that it is like, or its own.

    ``order`` is distinct in a key; ``fields`` is an array of numbers, of one length in a key.  Rows with a null in
    key, order or fields go.  Not a transitive closure: rows are compared to leaders only, so clusters do not drift.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(fields).cast("array<double>").alias("v")).filter("k IS NOT NULL AND o IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    rows = stored(rows)
    slices = max(1, -(-rows.count() // SLICE))
    left = stored(rows.repartitionByRange(slices, "k", "o").withColumn("c", F.spark_partition_id()))
    kind = f"k {kinds[key]}, o {kinds[order]}, leader {kinds[order]}"
    done = []

    def settle(key_: tuple, table: pa.Table) -> pa.Table:
        """A wave's rows among themselves."""
        table = table.sort_by("o")
        v, n = _matrix(table["v"], len(table)), len(table)
        heads: list[int] = []
        own = np.empty(n, np.int64)
        for lo in range(0, n, 256):
            part = v[lo : lo + 256]
            old = alike(part, v[heads]) if heads else np.zeros((len(part), 0), bool)
            before, inside = len(heads), alike(part, part)
            for i in range(len(part)):
                hit = np.flatnonzero(old[i, :before])
                near = heads[hit[0]] if len(hit) else next((h for h in heads[before:] if inside[i, h - lo]), None)
                own[lo + i] = lo + i if near is None else near
                if near is None:
                    heads.append(lo + i)
        return pa.table({"k": table["k"], "o": table["o"], "leader": table["o"].take(pa.array(own)), "v": table["v"]})

    def compare(key_: tuple, table: pa.Table, heads: pa.Table) -> pa.Table:
        """Later rows of a slice with the first of a wave's leaders that they are like, or null."""
        if not len(table):
            return table.select(["k", "o", "v", "c"]).append_column("leader", table["o"])
        at = np.full(len(table), -1)
        if len(heads):
            heads = heads.sort_by("o")
            v, w = _matrix(table["v"], len(table)), _matrix(heads["v"], len(heads))
            for lo in range(0, len(table), 512):
                hit = alike(v[lo : lo + 512], w)
                at[lo : lo + 512] = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
        leader = heads["o"].combine_chunks().take(pa.array(np.maximum(at, 0), mask=at < 0)) if len(heads) else pa.nulls(len(table), table["o"].type)
        return table.select(["k", "o", "v", "c"]).append_column("leader", leader)

    while not left.isEmpty():
        sizes = left.groupBy("k", "c").count()
        upto = F.sum("count").over(Window.partitionBy("k").orderBy("c").rowsBetween(Window.unboundedPreceding, 0))
        first = F.row_number().over(Window.partitionBy("k").orderBy("c")) == 1
        marked = stored(sizes.withColumn("wave", (upto <= WAVE) | first).select("k", "c", "wave"))
        now = left.join(marked.filter("wave").select("k", "c"), ["k", "c"])
        settled = stored(now.groupBy("k").applyInArrow(settle, f"{kind}, v array<double>"))
        done.append(settled.select("k", "o", "leader"))
        later = marked.filter("NOT wave").select("k", "c")
        heads = settled.filter("o = leader").select("k", "o", "v").join(later, "k")
        rest = left.join(later, ["k", "c"])
        met = stored(rest.groupBy("k", "c").cogroup(heads.groupBy("k", "c")).applyInArrow(compare, f"k {kinds[key]}, o {kinds[order]}, v array<double>, c int, leader {kinds[order]}"))
        done.append(met.filter("leader IS NOT NULL").select("k", "o", "leader"))
        left = met.filter("leader IS NULL").select("k", "o", "v", "c")
    out = done[0] if done else rows.select("k", "o", F.col("o").alias("leader"))
    for more in done[1:]:
        out = out.unionAll(more)
    return out.select(F.col("k").alias(key), F.col("o").alias(order), "leader")
