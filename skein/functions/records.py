"""Stored JSON records, read without trust: every value is checked by its kind, as column expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of content hashes, tunings that have a name, what a page and a record may hold.
HASH = r"\A[0-9a-f]{40}\z"
TUNINGS = ("standard", "dropD", "halfDown", "wholeDown", "dadgad", "openG", "openD", "custom")
PAGES, EVENTS, FIXES, SECONDS, BUDGET = 300, 800, 100, 3600, 500_000
SYSTEMS, STRINGS, FRETS = 8, 6, 24
LOWEST, HIGHEST, CAPO = 28, 76, 12

_EVENT, _FIX = "struct<system:int,x:double,t:double>", "struct<system:int,x:double,string:int,fret:int>"
_PAGE = f"struct<at:double,events:array<{_EVENT}>,fixes:array<{_FIX}>>"


def parsed(json: Column) -> Column:
    """The text as VARIANT; null if it is no JSON."""
    return F.try_parse_json(json)


def kind(v: Column) -> Column:
    """number, text, boolean, array, object or null (also for JSON's null)."""
    name = F.regexp_extract(F.schema_of_variant(v), r"\A([A-Z]+)", 1)
    numbers = F.when(name.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "number")
    return F.coalesce(numbers, F.when(name == "STRING", "text").when(name == "BOOLEAN", "boolean").when(name == "ARRAY", "array").when(name == "OBJECT", "object"))


def number(v: Column) -> Column:
    """A JSON number as a double; texts and all else are null."""
    return F.when(kind(v) == "number", v.try_cast("double"))


def whole(v: Column, low: int, high: int) -> Column:
    """A JSON number without a fraction from low to high, else null."""
    n = number(v)
    return F.when((n == F.floor(n)) & n.between(low, high), n.cast("int"))


def items(v: Column) -> Column:
    """The items of a JSON array, else an empty array."""
    return F.coalesce(F.when(kind(v) == "array", v.try_cast("array<variant>")), F.array().cast("array<variant>"))


def member(v: Column, name: str) -> Column:
    """A member of a JSON object, else null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def tenths(n: Column) -> Column:
    return F.floor(n * 10 + 0.5) / 10


def _rows(v: Column, make) -> Column:
    """``make(items of a row)`` for each item that is an array; rows that it makes null go."""
    rows = F.filter(items(v), lambda r: kind(r) == "array")
    return F.filter(F.transform(rows, lambda r: make(r.try_cast("array<variant>"))), lambda x: x.isNotNull())


def _event(row: Column) -> Column:
    system, x, t = whole(F.get(row, F.lit(0)), 0, SYSTEMS - 1), number(F.get(row, F.lit(1))), number(F.get(row, F.lit(2)))
    good = system.isNotNull() & x.isNotNull() & (F.abs(t) <= SECONDS)
    return F.when(good, F.struct(system.alias("system"), tenths(x).alias("x"), (F.floor(t * 100 + 0.5) / 100).alias("t")))


def _fix(row: Column) -> Column:
    system, x = whole(F.get(row, F.lit(0)), 0, SYSTEMS - 1), number(F.get(row, F.lit(1)))
    string, fret = whole(F.get(row, F.lit(2)), 1, STRINGS), whole(F.get(row, F.lit(3)), 0, FRETS)
    good = system.isNotNull() & x.isNotNull() & string.isNotNull() & fret.isNotNull()
    return F.when(good, F.struct(system.alias("system"), tenths(x).alias("x"), string.alias("string"), fret.alias("fret")))


def clean_timing(json: Column, *, most: int = PAGES, budget: int = BUDGET) -> Column:
    """When a record's notes sound, by page: map<hash, struct<at, events, fixes>>, or null if nothing is left.

    Pages need a content hash as key and an array of events.  Events (system, x, t) and fixes (system, x,
    string, fret) of wrong kinds or out of range go; places are rounded to tenths, times to hundredths.  The newest
    pages stay, ``most`` at most, until the first that exceeds ``budget`` characters of JSON; equal times go by hash.
    """
    pages = F.when(kind(member(parsed(json), "pages")) == "object", member(parsed(json), "pages").try_cast("map<string,variant>"))
    fit = F.filter(F.map_entries(pages), lambda e: e["key"].rlike(HASH) & (kind(member(e["value"], "events")) == "array"))
    made = F.transform(
        fit,
        lambda e: F.struct(
            (-F.coalesce(number(member(e["value"], "at")), F.lit(0.0))).alias("old"), e["key"].alias("key"),
            F.slice(_rows(member(e["value"], "events"), _event), 1, EVENTS).alias("events"), F.slice(_rows(member(e["value"], "fixes"), _fix), 1, FIXES).alias("fixes"),
        ),
    )
    newest = F.transform(F.slice(F.array_sort(made), 1, most), lambda p: F.struct(p["key"].alias("key"), F.struct((-p["old"]).alias("at"), p["events"].alias("events"), p["fixes"].alias("fixes")).alias("page")))
    return _within(newest, budget)


def _within(pages: Column, budget: int) -> Column:
    """The pages up to the first that takes more than the budget of characters, as a map; null if none."""
    kept = f"array<struct<key:string,page:{_PAGE}>>"

    def add(state: Column, p: Column) -> Column:
        size = state["size"] + F.length(F.to_json(p["page"]))
        return F.struct(size.alias("size"), F.when(size <= budget, F.concat(state["kept"], F.array(p))).otherwise(state["kept"]).cast(kept).alias("kept"))

    start = F.struct(F.lit(0).alias("size"), F.array().cast(kept).alias("kept"))
    out = F.aggregate(pages, start, add, lambda s: s["kept"])
    return F.when(F.size(out) > 0, F.map_from_entries(out))


def clean_listen(json: Column) -> Column:
    """Settings of following along: struct<tuning_id, tuning, capo, strictness, mode, confirmed>, or null for no object."""
    v = parsed(json)
    text = lambda name: F.when(kind(member(v, name)) == "text", member(v, name).try_cast("string"))
    one_of = lambda name, allowed: F.coalesce(F.when(text(name).isin(*allowed), text(name)), F.lit(allowed[0]))
    notes = F.transform(items(member(v, "tuning")), lambda n: whole(n, LOWEST, HIGHEST))
    tuning = F.when((F.size(notes) == STRINGS) & F.forall(notes, lambda n: n.isNotNull()), notes)
    capo = F.coalesce(number(member(v, "capo")), F.lit(0.0))
    capo = F.least(F.lit(CAPO), F.greatest(F.lit(0), F.floor(capo + 0.5))).cast("int")
    confirmed = F.coalesce((kind(member(v, "confirmed")) == "boolean") & member(v, "confirmed").try_cast("boolean"), F.lit(False))
    made = F.struct(
        one_of("tuningId", TUNINGS).alias("tuning_id"), tuning.alias("tuning"), capo.alias("capo"), one_of("strictness", ("lenient", "strict", "bass")).alias("strictness"),
        one_of("mode", ("wait", "play")).alias("mode"), confirmed.alias("confirmed"),
    )
    return F.when(kind(v) == "object", made)
