"""Connected parts of masks, and how two masks differ, as joins over rows of ink.

A mask is a table: pixels (image, y, x), or their runs (image, y, x0, x1), both ends included.  An image of any size,
or one image that holds most pixels, is spread over tasks by its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.components import connected
from skein.operators.intervals import within
from skein.sources.stages import stored

#: Rows of a tile, and its most columns; with one more at each side a row of it fits a long.
_TILE = 60
#: Rows and columns of a cell in which parts are labelled in one go.
_CELL = 64, 1024


def pixel_runs(pixels: DataFrame) -> DataFrame:
    """(image, y, x0, x1): neighbouring pixels of a row as one run; repeats count once, rows with a null go."""
    own = pixels.select("image", *[F.col(c).cast("long").alias(c) for c in ("y", "x")]).dropna().distinct()
    place = F.col("x") - F.row_number().over(Window.partitionBy("image", "y").orderBy("x"))
    return own.withColumn("g", place).groupBy("image", "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("g")


def parts(runs: DataFrame) -> DataFrame:
    """``runs`` (which must not overlap in a row) with ``root``: the first run, in reading order, of the 8-connected part.

    Runs of neighbouring rows touch if one begins within the other or at its corner.  Cells of ``_CELL`` rows and columns
    are labelled by themselves, many in a task; only what touches across the edges of cells goes through rounds of joins.
    """
    high, across = _CELL
    cell = F.explode(F.sequence(F.floor(F.col("x0") / across), F.floor(F.col("x1") / across)))
    cut = runs.withColumn("__tx", cell).withColumn("__ty", F.floor(F.col("y") / high)).withColumn("__a", F.greatest("x0", F.col("__tx") * across)).withColumn("__z", F.least("x1", F.col("__tx") * across + across - 1))
    order = ["image", "__ty", "__tx"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    local = stored(cut.repartition(*order).sortWithinPartitions(*order, "y", "__a").mapInArrow(_labelled(high, across), f"{kinds}, __ry bigint, __rx bigint"))
    edge = local.filter((F.pmod("y", F.lit(high)).isin(0, high - 1)) | (F.col("__a") == F.col("__tx") * across) | (F.col("__z") == F.col("__tx") * across + across - 1))
    edge = edge.select("image", F.col("y").cast("long").alias("row"), *[F.col(c).cast("long").alias(c) for c in ("__a", "__z")], F.struct("image", F.col("__ry").alias("y"), F.col("__rx").alias("x0")).alias("own"))
    pairs = []
    for d in (1, 0):  # the row below, and the same row
        upper = edge.select("image", (F.col("row") + d).alias("row"), F.col("own").alias("a"), "__a", (F.col("__a") - 1).alias("lo"), (F.col("__z") + 1).alias("hi"))
        lower = edge.select("image", "row", F.col("own").alias("b"), "__a", (F.col("__a") - 1).alias("lo"), (F.col("__z") + 1).alias("hi"))
        for one, other in ((lower, upper), (upper, lower))[: 1 + d]:
            met = within(one.drop("lo", "hi"), other.drop("__a"), key=["image", "row"], at="__a", lo="lo", hi="hi")
            pairs.append(met.filter("a <> b").select("a", "b"))
    pairs = stored(reduce(DataFrame.unionAll, pairs).distinct())
    first = local.filter(F.col("__a") == F.col("x0"))
    if pairs.isEmpty():
        return first.select(*runs.columns, F.struct(F.col("__ry").alias("y"), F.col("__rx").alias("x0")).alias("root"))
    roots = connected(pairs).select(F.col("node.image").alias("__image"), F.col("node.y").alias("__y"), F.col("node.x0").alias("__x"), "root")
    named = first.join(roots, (F.col("image") == F.col("__image")) & (F.col("__ry") == F.col("__y")) & (F.col("__rx") == F.col("__x")), "left")
    return named.select(*runs.columns, F.struct(F.coalesce("root.y", "__ry").alias("y"), F.coalesce("root.x0", "__rx").alias("x0")).alias("root"))


def _labelled(high: int, across: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs (image, __ty, __tx, y, __a, __z), sorted by these, with the first run (__ry, __rx) of their part within their cell."""

    def label(t: pa.Table, new: np.ndarray) -> pa.Table:
        y, x0, x1, tx = (t[c].to_numpy() for c in ("y", "__a", "__z", "__tx"))
        row, left = (np.cumsum(new) * (high + 1) + y % high) * (across + 4) + 2, tx * across
        x0, x1 = row + x0 - left, row + x1 - left  # ends of all runs on one line, in order
        lo = np.searchsorted(x1, x0 + across + 3)
        hi = np.searchsorted(x0, x1 + across + 5, "right")
        many = np.maximum(hi - lo, 0)
        a = np.repeat(np.arange(len(y)), many)
        b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + lo[a]
        root = np.arange(len(y))
        while True:
            least = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, before[a], least)
            np.minimum.at(root, before[b], least)
            root = root[root]
            if np.array_equal(root, before):
                break
        return t.append_column("__ry", pa.array(y[root].astype(np.int64))).append_column("__rx", pa.array(t["__a"].to_numpy()[root].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            new = _begins(held)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield from label(held.slice(0, last), new[:last]).to_batches()
                held = held.slice(last)
        if held is not None:
            yield from label(held, _begins(held)).to_batches()

    return run


def _begins(t: pa.Table) -> np.ndarray:
    """Whether each row is of another cell than the row before; rows without an image are alone."""
    new = np.ones(len(t), bool)
    for i, c in enumerate(("image", "__ty", "__tx")):
        other = pc.fill_null(pc.not_equal(t[c].slice(1), t[c].slice(0, len(t) - 1)), True).to_numpy()
        new[1:] = other if i == 0 else new[1:] | other
    return new


def part_boxes(labelled: DataFrame) -> DataFrame:
    """(image, root, area, x0, y0, x1, y1) of each part of ``parts``."""
    return labelled.groupBy("image", "root").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1")
    )


def keep_parts(labelled: DataFrame, wanted: DataFrame) -> DataFrame:
    """The runs of the parts that ``wanted`` (image, root) names."""
    return labelled.join(wanted.select("image", "root"), ["image", "root"], "left_semi").drop("root")


def without_small(runs: DataFrame, least: int) -> DataFrame:
    """The runs without parts of fewer than ``least`` pixels."""
    labelled = parts(runs)
    return keep_parts(labelled, part_boxes(labelled).filter(F.col("area") >= least))


def glyphs_only(runs: DataFrame, spacing: float) -> DataFrame:
    """The runs without parts too large for a glyph: 2.5 spacings wide and 1.5 tall, or of 6 squared spacings."""
    labelled = parts(runs)
    large = "(x1 - x0 + 1 >= {0} * 2.5 AND y1 - y0 + 1 >= {0} * 1.5) OR area >= 6 * {0} * {0}".format(float(spacing))
    return keep_parts(labelled, part_boxes(labelled).filter(f"NOT ({large})"))


def ink_difference(a: DataFrame, b: DataFrame, excluded: DataFrame | None = None, *, width: int = 8, least_ink: int = 1, least_changed: int = 1) -> DataFrame:
    """Pixels of masks ``a`` and ``b`` (image, y, x) that the other mask has not within one pixel.

    (image, changed, ink_a, ink_b, bins_content, bins_changed, clusters): columns of ``width`` pixels are
    bins; a bin counts with ``least_ink`` pixels of either mask or ``least_changed`` changed ones; changed
    bins with one other between them, or none, are one cluster.  Pixels of ``excluded`` are in no mask, so they lend no
    tolerance either.  Images without ink have no row; repeats count once.  The masks are compared in tiles of at most
    60 columns and 60 rows, whole bins or whole parts of one, so a pixel is sent once, but for those at a tile's edge.
    """
    side = _TILE // width * width if width <= _TILE else max(t for t in range(1, _TILE + 1) if width % t == 0)
    masks = []
    for name, mask in (("a", a), ("b", b), ("e", excluded)):
        if mask is not None:
            own = mask.select("image", *[F.col(c).cast("long").alias(c) for c in ("y", "x")]).dropna()
            masks.append(own.select("*", *[F.lit(int(name == n)).cast("long").alias(n) for n in ("a", "b", "e")]))
    ink = reduce(DataFrame.unionAll, masks)
    # a tile's rows are longs, bit 0 and the last one for the columns beside it; pixels at its edges go to the tiles there, too
    for c, size in (("x", side), ("y", _TILE)):
        place = F.pmod(F.col(c), F.lit(size))
        ink = ink.withColumn("d", F.explode(F.array(*map(F.lit, (0, -1, 1))))).filter((F.col("d") == 0) | ((F.col("d") < 0) & (place == 0)) | ((F.col("d") > 0) & (place == size - 1)))
        ink = ink.withColumn(f"t{c}", F.floor(F.col(c) / size) + F.col("d")).drop("d")
    bit = lambda c: F.bit_or(F.col(c) * F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("x") - F.col("tx") * side + 1).cast("int")))
    rows = ink.groupBy("image", "ty", "tx", "y").agg(*[bit(c).alias(c) for c in ("a", "b", "e")])
    rows = rows.select("image", "ty", "tx", "y", *[F.col(c).bitwiseAND(F.bitwise_not("e")).alias(c) for c in ("a", "b")])
    order = Window.partitionBy("image", "ty", "tx").orderBy("y")
    near = lambda c: reduce(
        Column.bitwiseOR, [F.col(c), *[F.when(step(F.col("y"), 1).over(order) == F.col("y") + d, step(F.col(c), 1).over(order)).otherwise(0) for step, d in ((F.lag, -1), (F.lead, 1))]]
    )
    wide = lambda c: F.col(c).bitwiseOR(F.shiftleft(c, 1)).bitwiseOR(F.shiftright(c, 1))
    rows = rows.withColumn("__a", near("a")).withColumn("__b", near("b")).filter(F.floor(F.col("y") / _TILE) == F.col("ty"))
    odd = F.col("a").bitwiseAND(F.bitwise_not(wide("__b"))).bitwiseOR(F.col("b").bitwiseAND(F.bitwise_not(wide("__a"))))
    rows = rows.select("image", "tx", "a", "b", odd.alias("odd"))
    part = min(width, side)  # of a bin, or the whole bin
    mask = F.call_function("shiftleft", F.lit((1 << part) - 1).cast("long"), (F.col("k") * part + 1).cast("int"))
    bins = rows.withColumn("k", F.explode(F.array(*map(F.lit, range(side // part))))).select(
        "image", F.floor((F.col("tx") * side + F.col("k") * part) / width).alias("bin"), *[F.bit_count(F.col(c).bitwiseAND(mask)).alias(c) for c in ("a", "b", "odd")],
        F.bit_count(F.col("a").bitwiseOR(F.col("b")).bitwiseAND(mask)).alias("ink"),
    )
    bins = bins.filter("ink > 0").groupBy("image", "bin").agg(F.sum("odd").alias("odd"), F.sum("ink").alias("ink"), F.sum("a").alias("ink_a"), F.sum("b").alias("ink_b"))
    changed = F.when(F.col("odd") >= least_changed, F.col("bin"))
    before = F.last(changed, ignorenulls=True).over(Window.partitionBy("image").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    begins = F.col("now").isNotNull() & (F.col("before").isNull() | (F.col("now") - F.col("before") > 2))
    return bins.withColumn("now", changed).withColumn("before", before).groupBy("image").agg(
        F.sum("odd").alias("changed"), F.sum("ink_a").alias("ink_a"), F.sum("ink_b").alias("ink_b"), F.count_if(F.col("ink") >= least_ink).alias("bins_content"),
        F.count("now").alias("bins_changed"), F.count_if(begins).alias("clusters"),
    )
