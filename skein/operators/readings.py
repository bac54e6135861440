"""Nested readings: events of notes as arrays of structs, found, edited, stored and turned into pitches by column expressions.

A reading's ``events`` column is array<struct<notes, x0, x1, xc, conf>>, a note is struct<string, fret,
tech, conf, x, w, flags>.  An edit is a new column; rows that it does not fit keep their events as
they are.  Places count from 0.  All work stays within a row, so no reading is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a note's flags, and the confidence below which a note is unsure; fixed values.
SET, CONFIRMED, WAS_UNSURE, UNSURE = 1, 2, 4, 0.5
#: Semitones of a natural harmonic above the open string, by fret; fixed values.
HARMONICS = {4: 28, 5: 24, 7: 19, 9: 28, 12: 12, 16: 28, 19: 19, 24: 24}
#: Open strings of standard tuning, first string first; fixed values.
STANDARD = (64, 59, 55, 50, 45, 40)
NOTE = "struct<string:int,fret:int,tech:array<string>,conf:double,x:double,w:double,flags:int>"


def with_span(notes: Column) -> Column:
    """An event of these notes: by string, with its extent, centre and least confidence."""
    x0 = F.array_min(F.transform(notes, lambda n: n["x"]))
    x1 = F.array_max(F.transform(notes, lambda n: n["x"] + n["w"]))
    conf = F.array_min(F.transform(notes, lambda n: F.coalesce(n["conf"], F.lit(1.0))))
    return F.struct(F.array_sort(notes).alias("notes"), x0.alias("x0"), x1.alias("x1"), ((x0 + x1) / 2).alias("xc"), conf.alias("conf"))


def _flagged(note: Column, bits: int) -> Column:
    return F.coalesce(note["flags"], F.lit(0)).bitwiseAND(F.lit(bits)) != 0


def unsure(note: Column) -> Column:
    """Below the sure confidence, and neither set nor confirmed by hand; a note without confidence is sure."""
    return (F.coalesce(note["conf"], F.lit(1.0)) < UNSURE) & ~_flagged(note, SET | CONFIRMED)


def edited(events: Column) -> Column:
    """Whether any note was set or confirmed by hand."""
    return F.exists(events, lambda ev: F.exists(ev["notes"], lambda n: _flagged(n, SET | CONFIRMED)))


def find_notes(df: DataFrame, keys: list[str], wanted, events: str = "events") -> DataFrame:
    """(keys, e, n): the places of the notes that ``wanted`` is true of."""
    flat = df.select(*keys, F.posexplode(events).alias("e", "ev")).select(*keys, "e", F.posexplode("ev.notes").alias("n", "note"))
    return flat.filter(wanted(F.col("note"))).select(*keys, "e", "n")


def _change(events: Column, e: int, change) -> Column:
    return F.transform(events, lambda ev, i: F.when(i == e, change(ev)).otherwise(ev))


def _note(note: Column, **new: Column) -> Column:
    return F.struct(*[new.get(k, note[k]).alias(k) for k in ("string", "fret", "tech", "conf", "x", "w", "flags")])


def _marked(note: Column, bit: int) -> Column:
    """The note's flags with ``bit``, and with ``WAS_UNSURE`` if it was."""
    was = F.when(F.coalesce(note["conf"], F.lit(1.0)) < UNSURE, WAS_UNSURE).otherwise(0)
    return F.coalesce(note["flags"], F.lit(0)).bitwiseOR(F.lit(bit)).bitwiseOR(was)


def set_fret(events: Column, e: int, n: int, fret: Column) -> Column:
    """A note's fret set by hand; null mutes it.  Frets beyond 0 to 24 change nothing."""
    fits = fret.isNull() | fret.between(0, 24)

    def tech(note: Column) -> Column:
        own = F.filter(F.coalesce(note["tech"], F.array().cast("array<string>")), lambda t: t != "x")
        return F.when(fret.isNull(), F.concat(own, F.array(F.lit("x")))).otherwise(own)

    one = lambda note: _note(note, fret=fret.cast("int"), tech=tech(note), conf=F.lit(1.0), flags=_marked(note, SET))
    change = lambda ev: with_span(F.transform(ev["notes"], lambda note, i: F.when(i == n, one(note)).otherwise(note)))
    return F.when(fits, _change(events, e, change)).otherwise(events)


def confirm_note(events: Column, e: int, n: int) -> Column:
    """A note looks right: sure from now on, unchanged otherwise."""
    one = lambda note: _note(note, conf=F.lit(1.0), flags=_marked(note, CONFIRMED))
    return _change(events, e, lambda ev: with_span(F.transform(ev["notes"], lambda note, i: F.when(i == n, one(note)).otherwise(note))))


def delete_note(events: Column, e: int, n: int) -> Column:
    """Without a note; an event that has none left goes too."""
    less = _change(events, e, lambda ev: with_span(F.filter(ev["notes"], lambda note, i: i != n)))
    return F.filter(less, lambda ev: F.size(ev["notes"]) > 0)


def add_note(events: Column, string: Column, fret: Column, x: Column, w: Column, spacing: Column) -> Column:
    """A note that was missed: into the first event within 0.4 spacings whose string is free, or else an event of its own, by centre."""
    tech = F.when(fret.isNull(), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    note = F.struct(string.cast("int").alias("string"), fret.cast("int").alias("fret"), tech.alias("tech"), F.lit(1.0).alias("conf"), x.cast("double").alias("x"), w.cast("double").alias("w"), F.lit(SET).alias("flags"))
    free = lambda ev: (F.abs(ev["xc"] - (x + w / 2)) <= 0.4 * spacing) & ~F.exists(ev["notes"], lambda m: m["string"] == string)
    at = F.array_position(F.transform(events, free), True)
    joined = F.transform(events, lambda ev, i: F.when(i + 1 == at, with_span(F.concat(ev["notes"], F.array(note)))).otherwise(ev))
    after = lambda a, b: F.when(a["xc"] < b["xc"], -1).when(a["xc"] > b["xc"], 1).otherwise(0)
    return F.when(at > 0, joined).otherwise(F.array_sort(F.concat(events, F.array(with_span(F.array(note)))), after))


def build_events(events: Column, tuning=STANDARD, capo: int = 0, min_conf: float = 0.5) -> Column:
    """What a listener expects: array<struct<e, notes: array<struct<string, fret, midi, required, bend>>, pitchless>>.

    Notes beyond the six strings are left out, and events without notes.  Muted notes have no pitch;
    ghost, grace and doubtful ones need not be heard; harmonics sound by the harmonic's interval.
    """
    opens = F.array(*[F.lit(m + capo) for m in tuning])
    rings = F.create_map(*[F.lit(x) for kv in HARMONICS.items() for x in kv])

    def heard(note: Column) -> Column:
        tech = F.coalesce(note["tech"], F.array().cast("array<string>"))
        muted = note["fret"].isNull() | F.array_contains(tech, "x")
        open_ = F.element_at(opens, note["string"])
        by = F.when(F.array_contains(tech, "harm"), F.coalesce(F.try_element_at(rings, note["fret"]), note["fret"])).otherwise(note["fret"])
        optional = F.array_contains(tech, "ghost") | F.array_contains(tech, "grace") | (F.coalesce(note["conf"], F.lit(1.0)) < min_conf)
        return F.struct(note["string"].alias("string"), F.when(~muted, note["fret"]).alias("fret"), F.when(~muted, open_ + by).alias("midi"), (~muted & ~optional).alias("required"))

    def event(ev: Column, i: Column) -> Column:
        notes = F.transform(F.filter(ev["notes"], lambda n: n["string"].between(1, len(tuning))), heard)
        return F.struct(i.alias("e"), notes.alias("notes"), (~F.exists(notes, lambda n: n["required"])).alias("pitchless"))

    return F.filter(F.transform(events, event), lambda ev: F.size(ev["notes"]) > 0)


#: Characters of stored techniques; bends and releases are ``b`` and ``r`` with the target fret; fixed values.
TECHNIQUES = {"h": "h", "p": "p", "s": "s", "/": "/", "\\": "\\", "~": "~", "x": "x", "grace": "g", "ghost": "(", "harm": "<"}


def encode_techniques(tech: Column, bend_to: Column) -> Column:
    """Techniques as a short text; unknown ones are left out."""
    known = F.create_map(*[F.lit(x) for kv in TECHNIQUES.items() for x in kv])
    target = F.coalesce(bend_to.cast("string"), F.lit(""))
    return F.array_join(F.transform(tech, lambda t: F.when(t.isin("b", "r"), F.concat(t, target)).otherwise(F.coalesce(F.try_element_at(known, t), F.lit("")))), "")


def decode_techniques(text: Column) -> Column:
    """struct(tech, bend_to) of such a text; characters that mean nothing are left out, the last target counts."""
    names = F.create_map(*[F.lit(x) for k, v in TECHNIQUES.items() for x in (v, k)])
    marks = F.regexp_extract_all(text, F.lit(r"([br]\d{1,2}|.)"), 1)
    tech = F.transform(marks, lambda m: F.when(F.left(m, F.lit(1)).isin("b", "r"), F.left(m, F.lit(1))).otherwise(F.try_element_at(names, m)))
    targets = F.filter(marks, lambda m: F.length(m) > 1)
    last = F.when(F.size(targets) > 0, F.substring(F.element_at(targets, -1), 2, 2).cast("int"))
    return F.struct(F.filter(tech, lambda t: t.isNotNull()).alias("tech"), last.alias("bend_to"))


def newest_entries(pages: Column, pattern: str, at, size, *, most: int, budget: int) -> Column:
    """A map's entries whose key fits, newest first, ``most`` at most, up to the first that exceeds the budget of their sizes.

    ``at`` and ``size`` are functions of an entry's value; sizes are not negative.  Equal times go by key.
    """
    fit = F.filter(F.map_entries(pages), lambda e: e["key"].rlike(pattern))
    newer = lambda a, b: F.when(at(a["value"]) > at(b["value"]), -1).when(at(a["value"]) < at(b["value"]), 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    first = F.slice(F.array_sort(fit, newer), 1, most)
    zero = F.struct(F.lit(0).cast("bigint").alias("spent"), F.lit(0).alias("n"))

    def add(state: Column, e: Column) -> Column:
        spent = state["spent"] + size(e["value"]).cast("bigint")
        return F.struct(spent.alias("spent"), (state["n"] + F.when(spent <= budget, 1).otherwise(0)).alias("n"))

    return F.map_from_entries(F.slice(first, F.lit(1), F.aggregate(first, zero, add, lambda s: s["n"])))


def union_by_right(left: Column, right: Column) -> Column:
    """The entries of two maps; of a key in both, the right one's."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def ordered_union(left: Column, right: Column) -> Column:
    """The different elements of two arrays, by first appearance."""
    return F.array_distinct(F.concat(left, right))


def canonical(label: Column, groups: list[list[str]]) -> Column:
    """The first name of the synonym group that has the label, or else the label."""
    names = F.create_map(*[F.lit(x) for g in groups for name in g for x in (name, g[0])])
    return F.coalesce(F.try_element_at(names, label), label)


def play_speed(c: Column) -> Column:
    """A practice speed: 0.25 to 2 in hundredths; nothing or nonsense is 1."""
    n = c.try_cast("double")
    n = F.when(n.isNull() | F.isnan(n) | (n == 0), 1.0).otherwise(n)
    return F.least(F.lit(2.0), F.greatest(F.lit(0.25), F.floor(n * 100 + 0.5) / 100))


def song_tempo(c: Column) -> Column:
    """Beats a minute, 20 to 400 in whole numbers; anything else is 0."""
    n = F.floor(F.coalesce(c.try_cast("double"), F.lit(0.0)) + 0.5)
    return F.when(n.between(20, 400), n).otherwise(0).cast("int")


def first_json_object(text: Column) -> Column:
    """The first line of a text that is a JSON object, as text; null without one."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.ltrim(x).startswith("{") & F.get_json_object(x, "$").isNotNull())
    return F.get(lines, F.lit(0))
