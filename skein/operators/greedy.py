"""Ordered rows folded into a small state, where the state soon forgets how it began: greedy groups, slots of a service.

What becomes of a row depends on all rows before it, but only by way of a state: a group's anchor, or when
slots come free.  So slices of a key are folded on their own, at first as if each
began anew; then with the states that the slices before them end with, as long as new ones
turn up.  That gives a table of jumps (slice, state at its begin) to (next slice, state at its begin).
The jumps that lead on from a key's first slice are found by doubling, and each slice is folded once
more with its true state.  One key may hold all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.stages import stored

#: Whole numbers of the index in a slice.
SLICE = 1 << 15

#: Plain lists: a step of a fold is too little work for arrays.
Row = list[float]
#: (rows, state or None at first) to (what becomes of each row, state at the end); states of one fold have one length.
Fold = Callable[[list[Row], Row | None], tuple[list[float], Row]]
#: Whether a row stays in the group of an anchor, given the row before it; whether it becomes the anchor then.
Stays = Callable[[Row, Row, Row], bool]
Leads = Callable[[Row, Row], bool]


def folded(df: DataFrame, key: str, index: str, fields: list[Column | str], fold: Fold, *, ties: tuple[str, ...] = (), name: str = "folded", size: int | None = None) -> DataFrame:
    """``df`` with what ``fold`` makes of each row as a double ``name``; stored.

    Rows go by ``index``, a whole number, then by ``ties``; a slice has ``size`` whole numbers (``SLICE``),
    so with sparse indices a larger one.  ``fields`` are the numbers that ``fold``
    sees, as doubles, a null as NaN.  Null keys are one key; rows without an index go; a column called ``name`` is
    replaced.  Further columns ``__c`` (the slice) and ``__order`` (the place in it) are for callers here.

    A slice is folded once for each different state that may reach it, and rounds are as many as
    there are such states, or as slices that a state takes to be forgotten.
    """
    own = [c for c in df.columns if c != name]
    kind = df.schema[key].dataType.simpleString()
    numbers = F.array(*[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(float("nan"))) for c in fields])
    rows = stored(df.filter(F.col(index).isNotNull()).select(*own, numbers.alias("__v"), F.floor(F.col(index) / (size or SLICE)).alias("__c")))
    order = [(c, "ascending") for c in (index, *ties)]
    slim = rows.select(F.col(key).alias("k"), F.col("__c").alias("c"), *[F.col(c).alias(f"o{i}") for i, c in enumerate((index, *ties))], F.col("__v").alias("v"))
    along = Window.partitionBy("k").orderBy("c")
    slices = stored(slim.groupBy("k", "c").count().select("k", "c", F.lead("c").over(along).alias("to"), F.row_number().over(along).alias("place")))

    def run(key_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The states at the end of a slice, for each of the states at its begin."""
        left = left.sort_by([(f"o{i}", "ascending") for i in range(len(order))])
        values = _rows(left["v"])
        ends = [fold(values, s)[1] for s in right["s"].to_pylist()]
        return right.append_column("e", pa.array(ends, pa.list_(pa.float64())))

    schema = f"k {kind}, c bigint, to bigint, s array<double>, e array<double>"
    asked = slices.select("k", "c", "to", F.lit(None).cast("array<double>").alias("s"))
    jumps, known = None, asked.select("k", "c", "s")
    while True:
        found = stored(slim.groupBy("k", "c").cogroup(asked.groupBy("k", "c")).applyInArrow(lambda k, a, b: run(k, a, b) if b.num_rows else b.append_column("e", b["s"]), schema))
        jumps = found if jumps is None else jumps.unionAll(found)
        reached = found.filter("to IS NOT NULL").select("k", F.col("to").alias("c"), F.col("e").alias("s")).distinct()
        new = reached.alias("n").join(known.alias("o"), _same("n", "o"), "left_anti")
        new = stored(new.join(slices.alias("z"), F.col("n.k").eqNullSafe(F.col("z.k")) & (F.col("n.c") == F.col("z.c"))).select("n.k", "n.c", "z.to", "n.s"))
        if new.isEmpty():
            break
        known, asked = known.unionAll(new.select("k", "c", "s")), new
    true = _true_entries(jumps.select("k", "c", "s", "to", F.col("e").alias("ts")), slices)

    def last(key_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by(order)
        out, _ = fold(_rows(left["__v"]), right["s"][0].as_py())
        return left.drop_columns("__v").append_column("__order", pa.array(np.arange(len(out), dtype=np.int64))).append_column(name, pa.array(out, pa.float64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__v").schema.fields)
    begun = true.select(F.col("k").alias(key), F.col("c").alias("__c"), "s")
    return stored(rows.groupBy(key, "__c").cogroup(begun.groupBy(key, "__c")).applyInArrow(last, f"{kinds}, __order bigint, `{name}` double"))


def greedy_groups(df: DataFrame, key: str, index: str, fields: list[Column | str], stays: Stays, leads: Leads = lambda anchor, row: False, *, ties: tuple[str, ...] = (), name: str = "group") -> DataFrame:
    """``df`` with ``name``: the place of each row's group among its key's groups, from 0.

    A row joins the group before it if it ``stays`` with that group's anchor: the group's first row, until
    ``leads`` names another.  Orders, fields and nulls as in ``folded``; its state is an anchor and the row before.
    """
    own = [c for c in df.columns if c != name]

    def fold(rows: list[Row], state: Row | None) -> tuple[list[float], Row]:
        anchor, last = (None, None) if state is None else (state[: len(fields)], state[len(fields) :])
        out = [0.0] * len(rows)
        for i, row in enumerate(rows):
            if anchor is None or not stays(anchor, last, row):
                anchor, out[i] = row, 1.0
            elif leads(anchor, row):
                anchor = row
            last = row
        return out, anchor + last

    done = folded(df, key, index, fields, fold, ties=ties, name="__opens")
    before = done.groupBy(F.col(key).alias("__k"), F.col("__c").alias("__at")).agg(F.sum("__opens").alias("__n"))
    so_far = F.sum("__n").over(Window.partitionBy("__k").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    before = before.select("__k", "__at", F.coalesce(so_far, F.lit(0)).alias("__before"))
    inside = F.sum("__opens").over(Window.partitionBy(key, "__c").orderBy("__order").rowsBetween(Window.unboundedPreceding, 0))
    numbered = done.withColumn("__g", inside).join(before, done[key].eqNullSafe(before["__k"]) & (done["__c"] == before["__at"]))
    return numbered.select(*own, (F.col("__before") + F.col("__g") - 1).cast("long").alias(name))


def admitted(jobs: DataFrame, key: str, start: str, end: str, *, slots: int = 1, ties: tuple[str, ...] = (), name: str = "admitted", size: int | None = None) -> DataFrame:
    """``jobs`` with whether each gets one of its key's slots when it starts: a job holds a slot from start to end.

    A job that finds no slot is refused and holds none, so whether a job is admitted depends on which ones were
    before it.  Starts are whole numbers; a slot is free again at its job's end; a null end holds a slot for good.
    Equal starts go by ``ties``; ``size`` as in ``folded``.
    """
    own = [c for c in jobs.columns if c != name]

    def fold(rows: list[Row], state: Row | None) -> tuple[list[float], Row]:
        held, out = [-math.inf] * slots if state is None else list(state), [0.0] * len(rows)
        for i, (now, until) in enumerate(rows):
            if held[-1] > -math.inf:
                held = sorted(-math.inf if h <= now else h for h in held)  # free slots are alike
            if held[0] == -math.inf:
                out[i] = 1.0
                if not until <= now:
                    held[0] = math.inf if math.isnan(until) else until
                    held.sort()
        return out, held

    done = folded(jobs, key, start, [start, end], fold, ties=ties, name="__got", size=size)
    return done.select(*own, (F.col("__got") > 0).alias(name))


def _rows(column: pa.ChunkedArray) -> list[Row]:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1).tolist()


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.k").eqNullSafe(F.col(f"{b}.k")) & (F.col(f"{a}.c") == F.col(f"{b}.c")) & F.col(f"{a}.s").eqNullSafe(F.col(f"{b}.s"))


def _true_entries(jumps: DataFrame, slices: DataFrame) -> DataFrame:
    """(k, c, s): the anchor that each slice begins with, by doubling the jumps from each key's first slice."""
    most = slices.agg(F.max("place")).first()[0] or 0
    true = slices.filter("place = 1").select("k", "c", F.lit(None).cast("array<double>").alias("s"))
    jumps, length = jumps.filter("to IS NOT NULL"), 1
    while length < most:
        jumps, true = stored(jumps), stored(true)
        step = true.alias("t").join(jumps.alias("j"), _same("t", "j")).select("j.k", F.col("j.to").alias("c"), F.col("j.ts").alias("s"))
        true = true.unionAll(step)
        ahead = jumps.select("k", F.col("c"), F.col("s"), "to", "ts").alias("b")
        meets = F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.to") == F.col("b.c")) & F.col("a.ts").eqNullSafe(F.col("b.s"))
        jumps = jumps.alias("a").join(ahead, meets).select("a.k", "a.c", "a.s", "b.to", "b.ts")
        length *= 2
    return true


def merge_lines(rows: DataFrame, key: str, *, y: str = "y", x0: str = "x0", x1: str = "x1", gap: float = 2.0) -> DataFrame:
    """Rows of ink (key, y, x0, x1) that lie under each other as lines: (key, line, y, x0, x1, len, n_rows).

    A row joins the line above it if it is at most ``gap`` below that line's last row and overlaps the
    line's first row.  A line stands at the mean of its rows weighted by their lengths, and has the
    extent of its longest row, the first of equal ones.  Rows without a place or extent go.

    A distance over ``gap`` ends a line whatever came before, so rows between two such distances, a chain, are lines of
    their own.  Slices of a key become lines in one pass; only chains that cross from one slice to
    the next are taken again, as greedy groups.
    """
    usable = rows.select(F.col(key).alias("k"), *[F.col(c).cast("long").alias(n) for c, n in ((y, "y"), (x0, "x0"), (x1, "x1"))]).filter("y IS NOT NULL AND x0 <= x1")
    usable = usable.withColumn("c", F.floor(F.col("y") / SLICE))
    down = Window.partitionBy("k", "c").orderBy("y", "x0", "x1")
    kind = usable.schema["k"].dataType.simpleString()
    lines = stored(usable.withColumn("first", F.row_number().over(down) == 1).mapInArrow(lambda batches: _lines(batches, gap), f"k {kind}, {', '.join(f'{n} bigint' for n in _LINE)}"))

    chain = F.col("chain")
    slices = lines.groupBy("k", "c").agg(
        F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.max(F.when(chain == 0, F.col("y1"))).alias("head"),
        F.max("chain").alias("last"), F.min(F.struct(-chain, "y0"))["y0"].alias("tail"),
    )
    along = Window.partitionBy("k").orderBy("c")
    meets = lambda upper, lower: F.coalesce(lower - upper <= gap, F.lit(False))
    slices = slices.withColumns({"above": meets(F.lag("bottom").over(along), F.col("top")), "below": meets(F.col("bottom"), F.lead("top").over(along))})
    crossed = stored(slices.filter("above OR below").select("k", "c", "head", "last", "tail", "above", "below"))
    if not crossed.isEmpty():
        at = lambda a, b: F.col(f"{a}.k").eqNullSafe(F.col(f"{b}.k")) & (F.col(f"{a}.c") == F.col(f"{b}.c"))
        again = usable.alias("u").join(crossed.alias("z"), at("u", "z")).filter("above AND y <= head OR below AND y >= tail").select("u.k", "y", "x0", "x1")
        within = lines.alias("u").join(crossed.alias("z"), at("u", "z")).filter("NOT (above AND chain = 0 OR below AND chain = last)").select("u.*")
        taken = within.drop("chain", "i", "y1").unionByName(_greedy_lines(again, gap).withColumn("c", F.floor(F.col("y0") / SLICE)))
        order = Window.partitionBy("k", "c").orderBy("y0", "f0", "f1")
        taken = stored(taken.withColumn("i", (F.row_number().over(order) - 1).cast("long")))
        lines = lines.drop("chain", "y1").alias("u").join(crossed.alias("z"), at("u", "z"), "left_anti").unionByName(taken)

    so_far = F.sum("count").over(along.rowsBetween(Window.unboundedPreceding, -1))
    before = lines.groupBy("k", "c").count().withColumn("before", so_far).filter("before > 0")
    met = F.col("u.k").eqNullSafe(F.col("z.k")) & (F.col("u.c") == F.col("z.c"))
    numbered = lines.alias("u").join(before.alias("z"), met, "left")
    return numbered.select(F.col("u.k").alias(key), (F.coalesce("before", F.lit(0)) + F.col("i")).cast("long").alias("line"), (F.col("weighted") / F.col("size")).alias("y"),
        F.col("m0").alias("x0"), F.col("m1").alias("x1"), (F.col("m1") - F.col("m0") + 1).alias("len"), "n_rows")


#: A line in its slice: its place, the place of its chain, the first row and the last row's y, sums, the longest row.
_LINE = ("c", "i", "chain", "y0", "f0", "f1", "y1", "weighted", "size", "m0", "m1", "n_rows")


def _lines(batches: Iterator[pa.RecordBatch], gap: float) -> Iterator[pa.RecordBatch]:
    """Lines of rows (k, c, y, x0, x1, first) that come in order, slice after slice; ``first`` opens a slice."""
    names = ["k", *_LINE]
    held, own = None, None  # the line that the next rows may continue, and its key
    a0 = a1 = last = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        c, y, x0, x1 = (batch[f].to_numpy() for f in ("c", "y", "x0", "x1"))
        new = batch["first"].to_numpy(zero_copy_only=False)
        apart = new.copy()
        apart[1:] |= y[1:] - y[:-1] > gap
        apart[0] |= y[0] - last > gap
        opens = []
        for at, (far, p, q) in enumerate(zip(apart.tolist(), x0.tolist(), x1.tolist())):
            if far or p > a1 or q < a0:
                opens.append(at)
                a0, a1 = p, q
        last = int(y[-1])
        goes_on = not opens or opens[0] > 0
        start = np.array([0] * goes_on + opens)
        end = np.append(start[1:], n) - 1
        size, part = x1 - x0 + 1, np.repeat(np.arange(len(start)), end - start + 1)
        longest = np.flatnonzero(size == np.maximum.reduceat(size, start)[part])
        longest = longest[np.unique(part[longest], return_index=True)[1]]
        # places count from the last row that opened a slice, or go on from the line before
        place, chains = np.arange(len(start)), np.cumsum(apart)[start]
        begin = np.maximum.accumulate(np.where(new[start], place, -1))
        i_before, chain_before = (0, 0) if held is None else (held[1] + (not goes_on), held[2])
        i = np.where(begin < 0, i_before + place, place - begin)
        chain = np.where(begin < 0, chain_before + chains, chains - chains[begin])
        table = np.stack([c[start], i, chain, y[start], x0[start], x1[start], y[end], np.add.reduceat(y * size, start), np.add.reduceat(size, start), x0[longest], x1[longest], end - start + 1])
        keys = batch["k"].take(pa.array(start))
        if goes_on:
            wider = table[10, 0] - table[9, 0] > held[10] - held[9]
            table[:6, 0] = held[:6]
            table[[7, 8, 11], 0] += held[[7, 8, 11]]
            if not wider:
                table[9:11, 0] = held[9:11]
        elif held is not None:
            yield pa.RecordBatch.from_arrays([own, *map(pa.array, held[:, None])], names)
        held, own = table[:, -1].copy(), keys[-1:]
        if len(start) > 1:
            yield pa.RecordBatch.from_arrays([keys[:-1], *map(pa.array, table[:, :-1])], names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([own, *map(pa.array, held[:, None])], names)


def _greedy_lines(rows: DataFrame, gap: float) -> DataFrame:
    """The same lines of rows (k, y, x0, x1) whose chains may be of any length, without their places."""

    def stays(anchor: Row, last: Row, row: Row) -> bool:
        return row[0] - last[0] <= gap and row[1] <= anchor[2] and anchor[1] <= row[2]

    lined = greedy_groups(rows, "k", "y", ["y", "x0", "x1"], stays, ties=("x0", "x1"), name="line")
    size = F.col("x1") - F.col("x0") + 1
    first, main = F.min(F.struct("y", "x0", "x1")).alias("first"), F.min_by(F.struct("x0", "x1"), F.struct(-size, "y", "x0")).alias("main")
    lines = lined.groupBy("k", "line").agg(first, main, F.sum(F.col("y") * size).alias("weighted"), F.sum(size).alias("size"), F.count("*").alias("n_rows"))
    return lines.select("k", F.col("first.y").alias("y0"), F.col("first.x0").alias("f0"), F.col("first.x1").alias("f1"), "weighted", "size", F.col("main.x0").alias("m0"), F.col("main.x1").alias("m1"), "n_rows")


def merge_screens(runs: DataFrame, key: str, order: str, length: str, shown: list[str], alike: Callable[[Row, Row], bool], *, name: str = "screen") -> DataFrame:
    """Consecutive runs that show one screen: a run joins those before it if it is like the longest of them so far.

    ``shown`` are the numbers by which ``alike`` compares two runs.  The longest run is the first of equal ones, so slow
    drift does not chain distinct screens together.
    """

    def stays(anchor: Row, last: Row, row: Row) -> bool:
        return alike(anchor[1:], row[1:])

    return greedy_groups(runs, key, order, [length, *shown], stays, lambda anchor, row: row[0] > anchor[0], name=name)
