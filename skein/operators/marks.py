"""Lines, notes and runs of pages: even groups, coverage, order and spread of notes, shared partials, appearances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _middle(ordered: Column, n: Column) -> Column:
    """Mean of the two middle ones of ``n`` ordered values, the middle one of an odd number."""
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def even_groups(lines: DataFrame, key: str, *, y: str, x0: str, x1: str, least: int = 4, most: int = 7) -> DataFrame:
    """Every ``least`` to ``most`` consecutive lines of a key that are evenly spaced and cover one span.

    (key, y0, y1, n, spacing, regularity, span).  Spacings of 3 to 60; gaps differ from their median by 15 % at most
    (1.01 if that is more); each line covers 70 % of the median span.  A row looks at the ``most`` lines from its own on.
    """
    w = Window.partitionBy(key).orderBy(y, x0, x1)
    ahead = lambda c, i: F.lead(F.col(c).cast("double"), i).over(w)
    d = lines.filter(F.col(y).isNotNull()).select(key, *[ahead(c, i).alias(f"{n}{i}") for i in range(most) for n, c in (("__y", y), ("__a", x0), ("__b", x1))])
    d = d.withColumn("n", F.explode(F.array(*map(F.lit, range(least, most + 1))))).withColumn("y1", F.get(F.array(*[f"__y{i}" for i in range(most)]), F.col("n") - 1)).filter("y1 IS NOT NULL")
    gaps = F.slice(F.array(*[F.col(f"__y{i + 1}") - F.col(f"__y{i}") for i in range(most - 1)]), F.lit(1), F.col("n") - 1)
    d = d.withColumn("g", F.sort_array(gaps)).withColumn("spacing", _middle(F.col("g"), F.col("n") - 1))
    far = F.greatest(F.get("g", F.col("n") - 2) - F.col("spacing"), F.col("spacing") - F.get("g", F.lit(0)))
    d = d.withColumn("far", far).withColumn("tol", F.greatest(F.col("spacing") * 0.15, F.lit(1.01))).filter(F.col("spacing").between(3, 60) & (F.col("far") <= F.col("tol")))
    for c in ("a", "b"):  # lines without an end come last
        ends = F.sort_array(F.slice(F.array(*[F.coalesce(f"__{c}{i}", F.lit(float("nan"))) for i in range(most)]), F.lit(1), F.col("n")))
        d = d.withColumn(c, F.nullif(_middle(ends, F.col("n")), F.lit(float("nan"))))
    d = d.withColumn("span", F.col("b") - F.col("a") + 1)
    covers = lambda i: (F.col("n") <= i) | (F.least(f"__b{i}", "b") - F.greatest(f"__a{i}", "a") + 1 >= F.col("span") * 0.7)
    good = d.filter(reduce(Column.__and__, map(covers, range(most))))
    return good.select(key, F.col("__y0").alias("y0"), "y1", "n", "spacing", (1 - F.col("far") / F.col("tol")).alias("regularity"), "span")


def line_coverage(pixels: DataFrame, key: str, *, line: str, hit: Column, share: float = 0.35) -> DataFrame:
    """(key, lines, coverage): the share of a key's lines that are inked along ``share`` of their length."""
    per = pixels.groupBy(key, line).agg(F.count("*").alias("__all"), F.count_if(hit).alias("__hit"))
    return per.groupBy(key).agg(F.count("*").alias("lines"), F.avg((F.col("__hit") >= share * F.col("__all")).cast("double")).alias("coverage"))


def wide_chords(notes: DataFrame, event, fret: str, *, most: int = 5) -> DataFrame:
    """Adds ``wide``: a fretted note further than ``most`` from the upper median of a chord that spans more than that.

    Open strings (0) and unknown frets (null) count for nothing.
    """
    w = Window.partitionBy(*([event] if isinstance(event, str) else event))
    held = F.when(F.col(fret) > 0, F.col(fret))
    d = notes.withColumn("__f", F.array_sort(F.collect_list(held).over(w)))
    med = F.get("__f", F.floor(F.size("__f") / 2).cast("int"))
    wide = (F.array_max("__f") - F.array_min("__f") > most) & (F.abs(held - med) > most)
    return d.withColumn("wide", F.coalesce(wide, F.lit(False))).drop("__f")


def unsound_strings(notes: DataFrame, key: str, *, event: str, string: str, at: Column, chord: float = 0.7, order: float = 0.3) -> DataFrame:
    """(key, string) of strings that cannot be trusted; ``at`` is a note's place in units of the staff's spacing.

    A chord spread over more than ``chord`` marks all its strings; a note more than ``order`` left of a note of an earlier
    event marks both.  Who lies left is told by running extremes of the earlier and later events, without pairs.
    """
    own, w = Window.partitionBy(key, event), Window.partitionBy(key).orderBy(event)
    d = notes.select(key, event, string, at.alias("__x")).filter(F.col("__x").isNotNull())
    before = F.max("__x").over(w.rangeBetween(Window.unboundedPreceding, -1))
    after = F.min("__x").over(w.rangeBetween(1, Window.unboundedFollowing))
    spread = F.max("__x").over(own) - F.min("__x").over(own) > chord
    bad = spread | F.coalesce(F.col("__x") < before - order, F.lit(False)) | F.coalesce(F.col("__x") - order > after, F.lit(False))
    return d.withColumn("__bad", bad).filter("__bad").select(key, string).distinct()


def partials(notes: DataFrame, keys: list[str], *, hz: str, stiff: float = 0.0, most: int = 24) -> DataFrame:
    """The first partials of every note: (keys, partial, partial_hz), with the stretch of a stiff string."""
    k = F.col("partial").cast("double")
    out = notes.filter(F.col(hz) > 0).withColumn("partial", F.explode(F.sequence(F.lit(1), F.lit(most))))
    return out.withColumn("partial_hz", k * F.col(hz) * F.sqrt(1 + stiff * k * k)).select(*keys, "partial", "partial_hz")


def own_partials(df: DataFrame, key: str, *, note: str, hz: str, sounding: Column, cents: int = 50) -> DataFrame:
    """Adds ``own``: no other sounding note of the key has a partial within ``cents``.

    The least and the greatest sounding note within reach tell whether there is another one, so no pairs are formed.
    """
    w = Window.partitionBy(key).orderBy("__c").rangeBetween(-cents, cents)
    who = F.when(sounding, F.col(note))
    d = df.withColumn("__c", F.log2(hz) * 1200)
    other = (F.min(who).over(w) != F.col(note)) | (F.max(who).over(w) != F.col(note))
    return d.withColumn("own", ~F.coalesce(other, F.lit(False))).drop("__c")


def capped_by_role(df: DataFrame, key: str, *, role: str, ranks: dict[str, int], order: list[str], most: int = 24) -> DataFrame:
    """The first ``most`` rows of a key by the rank of their role, then in their own order; unknown roles come last."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col(role)), F.lit(max(ranks.values()) + 1))
    w = Window.partitionBy(key).orderBy(rank, *order)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def winner_first(df: DataFrame, key: str, label: str, order: str, winner: Column) -> DataFrame:
    """Adds ``turn``: the order in which a key's choices are tried, the last winner first, then as given."""
    first = F.coalesce((F.col(label) != winner).cast("int"), F.lit(1))
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(first, order)))


def appearances(runs: DataFrame, page: str, *, group: str, start: str, end: str, fps: float, offset: float = 0.0, least: int = 7) -> DataFrame:
    """What a page's runs of frames say about it; group 0 is its first appearance, higher groups are repeats.

    (page, t_start, t_end, also_at, candidates).  Candidate frames come from the longest run (the first of equals); below
    ``least`` the rest of the first appearance joins, then the repeats.  Runs are whole frames, ends included.
    """
    told = lambda f: F.floor((f / fps + offset) * 100 + 0.5) / 100
    at = F.struct(F.col(start).alias("s"), F.col(end).alias("e"))
    own = F.col(group) == 0
    anchor = F.max_by(F.when(own, at), F.when(own, F.struct((F.col(end) - F.col(start)).alias("n"), (-F.col(start)).alias("f"))))
    first = runs.groupBy(page, group).agg(F.min(start).alias("s"), F.max(end).alias("e"), F.array_sort(F.collect_list(at)).alias("runs"), anchor.alias("anchor"))
    frames = lambda c: F.flatten(F.transform(c, lambda r: F.sequence(r["s"], r["e"])))
    p = first.groupBy(page).agg(
        F.max(F.when(own, F.col("s"))).alias("s"), F.max(F.when(own, F.col("e"))).alias("e"), F.max("anchor").alias("anchor"),
        F.flatten(F.collect_list(F.when(own, F.col("runs")))).alias("mine"), F.flatten(F.collect_list(F.when(~own, F.col("runs")))).alias("again"),
        F.array_sort(F.collect_list(F.when(~own, F.struct(group, "s")))).alias("groups"))
    p = p.filter(F.col("anchor").isNotNull()).withColumn("c", F.sequence("anchor.s", "anchor.e"))
    for more in ("mine", "again"):
        p = p.withColumn("c", F.when(F.size("c") < least, F.array_union("c", frames(F.col(more)))).otherwise(F.col("c")))
    return p.select(page, told(F.col("s")).alias("t_start"), told(F.col("e") + 1).alias("t_end"), F.transform("groups", lambda g: told(g["s"])).alias("also_at"), F.array_sort("c").alias("candidates"))
