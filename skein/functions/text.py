"""Text expressions: folding, grammars, version keys, classifiers, labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skein.functions.numeric import half_up

#: Semitone names; fixed values.
NOTE_NAMES = ("C", "C♯", "D", "D♯", "E", "F", "F♯", "G", "G♯", "A", "A♯", "B")


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """NFKC and lower case; Spark has no NFKC, so this is the one text function in Python."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).lower())


def contains_all(haystack: Column, query: str) -> Column:
    """Whether every white-space separated term of the query occurs."""
    out = F.lit(True)
    for term in query.split():
        out = out & haystack.contains(term)
    return out


def note_name(midi: Column) -> Column:
    names = F.array(*map(F.lit, NOTE_NAMES))
    return F.concat(F.element_at(names, (F.pmod(midi, F.lit(12)) + 1).cast("int")), (F.floor(midi / 12) - 1).cast("string"))


#: string ':' lead? body bend? flags; only a number, or a grace note's, may bend; see parse_note.
NOTE_PATTERN = r"^([1-6]):([hps/\\]?)(?:(g?)(\d{1,2})(?:([br])(\d{1,2}))?|([xX])|\((\d{1,2})\)|<(\d{1,2})>)(~?)(\??)$"
#: Its groups, with commas between; no group holds one.
_PARTS = "," + ",".join(f"${i}" for i in range(1, 12))


def parse_note(note: Column) -> Column:
    """One note as struct(string, lead, fret, muted, ghost, harmonic, grace, bend, release, vibrato, unsure, tech), or null.

    ``bend`` is the fret that a bend or a release ends at.  ``tech`` lists all marks: vibrato, bend or
    release, lead, kind.
    """
    return _bound(F.split(F.regexp_replace(F.when(note.rlike(NOTE_PATTERN), note), NOTE_PATTERN + r"[\s\S]*", _PARTS), ","), _note)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _note(parts: Column) -> Column:
    """What ``parse_note`` makes of the groups of its pattern; null of null."""
    part = [F.get(parts, F.lit(i)) for i in range(12)]
    number = lambda c: F.when(c != "", c.cast("int"))
    fret = F.coalesce(number(part[4]), number(part[8]), number(part[9]))
    ok = parts.isNotNull() & (fret.isNull() | (fret <= 24))
    marks = [(part[10] != "", F.lit("~")), (part[5] != "", part[5]), (part[2] != "", part[2]), (part[8] != "", F.lit("ghost")), (part[9] != "", F.lit("harm")), (part[3] != "", F.lit("grace")), (part[7] != "", F.lit("x"))]
    tech = F.filter(F.array(*[F.when(c, v) for c, v in marks]), lambda t: t.isNotNull())
    return F.when(
        ok,
        F.struct(
            part[1].cast("int").alias("string"), F.when(part[2] != "", part[2]).alias("lead"), fret.alias("fret"), (part[7] != "").alias("muted"), (part[8] != "").alias("ghost"),
            (part[9] != "").alias("harmonic"), (part[3] != "").alias("grace"), number(part[6]).alias("bend"), (part[5] == "r").alias("release"), (part[10] != "").alias("vibrato"), (part[11] != "").alias("unsure"), tech.alias("tech"),
        ),
    )


def parse_event(event: Column) -> Column:
    """Notes apart by white space as struct(bar, notes), or null: each has to be a note, and no string is named twice.  ``|`` is a bar."""
    tokens = F.split(F.trim(event), r"\s+")
    bar = F.trim(event) == "|"

    def of(notes: Column) -> Column:
        good = ~F.exists(notes, lambda n: n.isNull()) & (F.size(F.array_distinct(F.transform(notes, lambda n: n["string"]))) == F.size(notes))
        return F.when(bar, F.struct(F.lit(True).alias("bar"), F.slice(notes, 1, 0).alias("notes"))).when(good, F.struct(F.lit(False).alias("bar"), notes.alias("notes")))

    return _bound(F.transform(tokens, parse_note), of)


def version_key(v: Column) -> Column:
    """Sortable key of a semantic version; a release sorts after its pre-releases, nonsense is null."""
    pattern = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?$"
    pre = F.regexp_extract(v, pattern, 4)
    parts = F.transform(F.split(pre, "\\."), lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(p, 12, "0"))).otherwise(F.concat(F.lit("1"), p)))
    number = [F.lpad(F.regexp_extract(v, pattern, i), 12, "0") for i in (1, 2, 3)]
    tail = F.when(pre == "", F.lit("~")).otherwise(F.array_join(parts, "."))
    return F.when(v.rlike(pattern), F.concat_ws(".", *number, tail))


def classify(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first rule (regular expression, label) that matches."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def natural_key(c: Column, width: int = 20) -> Column:
    """Sort key in which every number of a title counts as a number, and case and accents do not count."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), 1)
    return folded(F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), width, "0")).otherwise(p)), ""))


def folded(c: Column) -> Column:
    """A text that compares without case and accents (by the Unicode collation of that strength)."""
    return F.collate(c, "UNICODE_CI_AI")


def clock(seconds: Column) -> Column:
    """m:ss"""
    whole = F.floor(seconds)
    return F.format_string("%d:%02d", F.floor(whole / 60), F.pmod(whole, F.lit(60)))


def byte_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", half_up(n / 1024.0, 10))).otherwise(F.format_string("%.1f MB", half_up(n / float(1 << 20), 10)))


def safe_name(c: Column, longest: int = 80) -> Column:
    """A file name: reserved characters to spaces, runs collapsed, dots and spaces off the ends."""
    return F.left(F.btrim(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]', " "), " +", " "), F.lit(" .")), F.lit(longest))
