"""Small rules of one row: settings, ranges, ages, addresses and times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.numeric import clamp, half_up

#: Least and greatest speed and beats a minute; fixed values.
SPEED, BPM = (0.25, 2.0), (20, 400)
_RANGE = r"\Abytes=([0-9]*)-([0-9]*)\z"


def clamp_speed(c: Column) -> Column:
    """A speed of two decimals within its bounds; null and 0 are 1."""
    return clamp(half_up(F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1.0)), 100), *SPEED)


def clean_bpm(c: Column) -> Column:
    """Whole beats a minute; null and what lies out of bounds is 0, not clamped."""
    n = F.floor(F.coalesce(c, F.lit(0.0)) + 0.5)
    return F.when(n.between(*BPM), n).otherwise(0).cast("bigint")


def parse_rate(c: Column) -> Column:
    """``a/b`` as a number; 0 unless both are above 0."""
    a, b = (F.get(F.split(c, "/"), i).try_cast("double") for i in (0, 1))
    return F.coalesce(F.when((a > 0) & (b > 0), F.try_divide(a, b)), F.lit(0.0))


def byte_range(header: Column, size: Column) -> Column:
    """What a ``Range`` header asks of ``size`` bytes: struct(status, start, end), both ends included.

    200 and all bytes without a header, 206 with a range that starts within the file (open-ended and
    suffix forms too, cut at the end), else 416 and nulls.
    """
    none = F.lit(None).cast("bigint")
    first, second = (F.regexp_extract(header, _RANGE, g).try_cast("bigint") for g in (1, 2))
    start = F.when(first.isNull(), F.greatest(F.lit(0).cast("bigint"), size - second)).otherwise(first)
    end = F.when(first.isNull() | second.isNull(), size - 1).otherwise(F.least(second, size - 1))
    fits = header.rlike(_RANGE) & (first.isNotNull() | second.isNotNull()) & (start <= end) & (start < size)
    answer = lambda status, a, b: F.struct(F.lit(status).alias("status"), a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))
    return F.when(F.coalesce(header, F.lit("")) == "", answer(200, F.lit(0), size - 1)).when(fits, answer(206, start, end)).otherwise(answer(416, none, none))


def client_ip(forwarded: Column, address: Column, trust: bool = True) -> Column:
    """The first forwarded address if proxies are trusted and it is not blank, else the socket's, else ``unknown``."""
    first = F.nullif(F.trim(F.get(F.split(forwarded, ","), 0)), F.lit(""))
    return F.coalesce(*([first] if trust else []), address, F.lit("unknown"))


def age_days(version: Column, now: Column) -> Column:
    """Whole days from a version that starts with ``yyyy.mm.dd`` to ``now`` in seconds, 0 at least; null for others."""
    day = F.try_to_date(F.nullif(F.regexp_extract(version, r"\A([0-9]{4}\.[0-9]{2}\.[0-9]{2})", 1), F.lit("")), "yyyy.MM.dd")
    return F.when(day.isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.floor(now / 86400 - F.unix_date(day) + 0.5)))


def how_long_ago(at: Column, now: Column) -> Column:
    """``just now``, minutes, hours or days ago, from a week on the date; seconds since 1970, null is ''."""
    ago = now - at

    def unit(seconds: int, name: str) -> Column:
        n = F.floor(ago / seconds + 0.5)
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    days = F.when(F.floor(ago / 86400 + 0.5) == 1, "yesterday").otherwise(unit(86400, "day"))
    date = F.date_from_unix_date(F.floor(at / 86400).cast("int")).cast("string")
    return F.when(at.isNull(), "").when(ago < 60, "just now").when(ago < 3600, unit(60, "minute")).when(ago < 86400, unit(3600, "hour")).when(ago < 7 * 86400, days).otherwise(date)


def spread_times(t0: Column, t1: Column, count: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``count`` even times from share ``low`` to share ``high`` of the span; its middle for one or none."""
    span = F.greatest(F.lit(0.0), t1 - t0)
    many = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), count - 1).cast("int")), lambda i: t0 + span * (F.lit(low) + F.lit(high - low) * i / (count - 1)))
    return F.when(count <= 1, F.array(t0 + span * (low + high) / 2)).otherwise(many)


def parse_sequence(c: Column) -> Column:
    """``t:id t:id`` as array<struct<t,id>> by t; equal times keep their order, null and blank are empty."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    pairs = F.transform(words, lambda w, i: F.struct(F.get(F.split(w, ":"), 0).try_cast("double").alias("t"), i.alias("i"), F.get(F.split(w, ":"), 1).alias("id")))
    kind = "array<struct<t:double,id:string>>"
    return F.coalesce(F.transform(F.array_sort(pairs), lambda p: F.struct(p["t"].alias("t"), p["id"].alias("id"))).cast(kind), F.array().cast(kind))


def even_rect(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A rectangle of even whole numbers within a frame, struct(x, y, w, h); null if a number is missing or not finite."""
    given = [x, y, w, h]
    ok = (width >= 2) & (height >= 2)
    for c in given:
        ok = ok & c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))
    even = lambda c: c - c % 2
    low = lambda c, most: even(F.greatest(F.lit(0).cast("bigint"), F.least(F.floor(c), most - 2)))
    ex, ey = low(x, width), low(y, height)
    ew, eh = (even(F.greatest(F.lit(2).cast("bigint"), F.least(F.floor(c), most - at))) for c, most, at in ((w, width, ex), (h, height, ey)))
    rect = F.struct(ex.alias("x"), ey.alias("y"), ew.alias("w"), eh.alias("h"))
    return F.when(F.coalesce(ok, F.lit(False)), rect)


def local_gain(value: Column, peak: Column, contrast: Column) -> Column:
    """A plane's value scaled so that the brightest of its surroundings reads as ``contrast``; cut to 0..255, fractions dropped."""
    return F.least(F.lit(255).cast("bigint"), F.floor(value * contrast / F.greatest(peak, 0.75 * contrast)))


def low_resolution(height: Column, advertised: Column) -> Column:
    """Whether a picture is low: under 540 rows, or under six tenths of at least 720 advertised ones."""
    told = F.coalesce(advertised, F.lit(0))
    return F.coalesce((height > 0) & ((height < 540) | ((told >= 720) & (height < told * 0.6))), F.lit(False))


def pair_class(changed: Column, ink_a: Column, ink_b: Column, local: Column, *, floor: float, ratio: float, minor: float, cell: float) -> Column:
    """``IDENTICAL``, ``TRANSITION`` or ``STABLE`` of two neighbouring frames, by changed ink against all ink."""
    ref = F.greatest(ink_a, ink_b, F.lit(floor))
    share = changed / ref
    moved = (share > ratio) | ((share > minor) & (local >= cell))
    return F.when(changed <= F.greatest(F.lit(2.0), 0.002 * ref), "IDENTICAL").when(moved, "TRANSITION").otherwise("STABLE")


def decibels(c: Column) -> Column:
    """20 log10 of an amplitude; silence is -200."""
    return 20 * F.log10(c + 1e-10)


def saturated(r: Column, g: Column, b: Column) -> Column:
    """Whether a pixel has a clear colour: its channels are over 60 apart."""
    return F.greatest(r, g, b) - F.least(r, g, b) > 60


def knobs(sensitivity: float = 0.5) -> dict[str, float]:
    """Thresholds of a page scan at a sensitivity from 0 to 1: each a line between two fixed ends."""
    s = min(1.0, max(0.0, sensitivity))
    # Fixed values.
    ends = {"ratio": (0.25, 0.08), "minor": (0.06, 0.025), "cell": (0.35, 0.15), "min_run_s": (1.25, 0.5), "change": (0.5, 0.3), "page_ratio": (0.12, 0.04)}
    return {**{k: a + (b - a) * s for k, (a, b) in ends.items()}, "cell_floor": 24.0 if s <= 0.5 else 24 - 14 * (2 * s - 1)}
