"""Rules of requests, releases and names: refusals, claims, assets, headers and templates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of ids, of content hashes and of page files.
ID, HASH, PAGE = r"(?i)\A[a-z0-9]{1,16}-[a-z0-9-]{1,40}\z", r"\A[0-9a-f]{40}\z", r"\Apage-\d{3,4}(?:-[0-9a-f]{8})?(?:-original)?\.png\z"


def origin_host(origin: Column) -> Column:
    """Lower-cased host and port of an origin, without a scheme's own port; null if it is no URL."""
    scheme, host = (F.lower(F.regexp_extract(origin, r"\A([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#@\s]+)", i)) for i in (1, 2))
    own = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    return F.nullif(own, F.lit(""))


def refusal(host: Column, site: Column, origin: Column, method: Column, kind: Column, *, allowed: list[str], local: bool = True) -> Column:
    """Why a request is refused, the first rule that holds: host, site, bad origin, origin or content type; else null.

    Hosts are only looked at where the service is ``local``.  Null and empty headers are absent; an absent host is not allowed.
    """
    known = lambda c: F.coalesce(c, F.lit("")).isin(allowed)
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    asked = origin_host(origin)
    media = F.lower(F.trim(F.get(F.split(F.coalesce(kind, F.lit("")), ";"), F.lit(0))))
    out = F.when(F.lit(local) & ~known(F.lower(host)), "403 host").when(given(site) & ~site.isin("same-origin", "none"), "403 site")
    out = out.when(given(origin) & asked.isNull(), "403 bad origin").when(F.lit(local) & given(origin) & ~known(asked), "403 origin")
    return out.when((method == "POST") & (media != "application/json"), "415 type")


def takeover_wait(me: Column, claimant: Column, claimed: Column, owner: Column, touched: Column, now: Column, *, claim: int = 10, idle: int = 900) -> Column:
    """Seconds to wait before someone may take a job over, null if at once; times are seconds.

    Someone else's claim holds for ``claim`` seconds (told as 5 at least), someone else's job until it was left alone for
    ``idle`` seconds (told as 30 at least; never touched counts as touched at 0).
    """
    age, left = now - claimed, F.lit(idle) - (now - F.coalesce(touched, F.lit(0)))
    held = claimant.isNotNull() & ~claimant.eqNullSafe(me) & (age < claim)
    busy = owner.isNotNull() & ~owner.eqNullSafe(me) & (left > 0)
    return F.when(held, F.greatest(F.lit(5), F.ceil(F.lit(claim) - age))).when(busy, F.greatest(F.lit(30), F.ceil(left))).cast("bigint")


def pick_asset(names: Column, platform: str, arm: bool = False) -> Column:
    """The first of the file names that fits a platform (darwin, win32, linux or appimage), else null.

    A name fits by its ending and by whether it says arm64, without regard to case; a package of linux ends in its
    machine's name.  An arm64 machine of win32 runs the other installer where none is its own.
    """
    ending = {"darwin": ".dmg", "win32": ".exe", "linux": "_arm64.deb" if arm else "_amd64.deb", "appimage": ".appimage"}.get(platform)
    if ending is None:
        return F.lit(None).cast("string")
    first = lambda own: F.get(F.filter(names, lambda n: F.endswith(F.lower(n), F.lit(ending)) & (F.contains(F.lower(n), F.lit("arm64")) == own)), F.lit(0))
    return F.coalesce(first(F.lit(True)), first(F.lit(False))) if arm and platform == "win32" else first(F.lit(arm))


def sha256_digest(c: Column) -> Column:
    """``sha256:`` and 64 hexadecimal digits, lower-cased; else null."""
    return F.when(c.rlike(r"(?i)\Asha256:[0-9a-f]{64}\z"), F.lower(c))


def link_or(url: Column, prefix: str, fallback: str) -> Column:
    """The url if it starts with the prefix, else the fallback."""
    return F.when(url.startswith(prefix), url).otherwise(F.lit(fallback))


def disposition(name: Column) -> Column:
    """A ``Content-Disposition`` header that offers a name, once in plain characters and once in UTF-8."""
    plain = F.regexp_replace(F.regexp_replace(name, r"[^\x20-\x7e]", "_"), r'["\\]', "'")
    coded = F.url_encode(name)
    for code, char in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = F.regexp_replace(coded, code, char)
    return F.concat(F.lit('attachment; filename="'), plain, F.lit("\"; filename*=UTF-8''"), coded)


def _beyond_latin(classes: str) -> str:
    """A pattern for the characters of some classes that are not in Latin-1."""
    return rf"[{classes}&&[^\x00-\xff]]"


def latin(c: Column) -> Column:
    """A text in Latin-1: full-width signs become plain ones, other signs go by their Unicode category.

    Quotes and corner brackets become quotes, dashes a hyphen, other brackets square ones, separators and
    white space one space; all else beyond Latin-1 is left out, ligatures and other compatibility forms too.
    """
    full = range(0xFF01, 0xFF5F)
    c = F.translate(c, "".join(map(chr, full)), "".join(chr(x - 0xFEE0) for x in full))
    by_class = {
        "\\u2018-\\u201b": "'",
        "\\u201c-\\u201f\\p{Pi}\\p{Pf}\\u300c-\\u300f": '"',
        "\\p{Pd}": "-",
        "\\p{Ps}": "[",
        "\\p{Pe}": "]",
    }
    for classes, plain in by_class.items():
        c = F.regexp_replace(c, _beyond_latin(classes), plain)
    spaced = F.regexp_replace(c, r"[\s\p{Z}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[^\x20-\x7e\u00a0-\u00ff]", ""), " +", " "))


def wrapped(c: Column, width: int, *, most: int = 3, empty: str = "Untitled") -> Column:
    """The first lines of a text, words filled up to ``width`` characters; a longer word has its own line."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")

    def put(lines: Column, w: Column) -> Column:
        room = (F.size(lines) > 0) & (F.length(F.element_at(lines, -1)) + 1 + F.length(w) <= width)
        return F.when(room, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat_ws(" ", F.element_at(lines, -1), w)))).otherwise(F.concat(lines, F.array(w)))

    # Only the lines that are returned are built: of what follows, ``most`` + 1 lines stand for all.
    step = lambda lines, w: F.when(F.size(lines) > most, lines).otherwise(put(lines, w))
    lines = F.aggregate(words, F.array().cast("array<string>"), step)
    return F.when(F.size(words) == 0, F.array(F.lit(empty))).otherwise(F.slice(lines, 1, most))


def page_key(sheet: Column, index: Column) -> Column:
    """Sheet and number of a page, the number with four digits or more."""
    n = index.cast("string")
    return F.concat_ws(":", sheet, F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n))


def new_id(ms: Column) -> Column:
    """A fresh id: the time in base 36 and eight random hexadecimal digits."""
    return F.concat_ws("-", F.lower(F.conv(ms.cast("string"), 10, 36)), F.substring(F.uuid(), 1, 8))


def section_of(changelog: Column, version: Column) -> Column:
    """What stands under ``## <version>`` up to the next such heading, trimmed; null if nothing does."""
    lines = F.split(F.regexp_replace(changelog, "\r\n", "\n"), "\n")
    at = F.array_position(F.transform(lines, lambda l: F.trim(l)), F.concat(F.lit("## "), version)).cast("int")
    rest = F.slice(lines, at + 1, F.size(lines))
    until = F.array_position(F.transform(rest, lambda l: l.startswith("## ")), F.lit(True)).cast("int")
    body = F.array_join(F.when(until > 0, F.slice(rest, 1, until - 1)).otherwise(rest), "\n")
    return F.when(at > 0, F.nullif(F.regexp_replace(body, r"\A\s+|\s+\z", ""), F.lit("")))


def fill(template: Column, values: Column) -> Column:
    """``{{name}}`` replaced by the map's value; names that the map does not have stay."""
    found = F.regexp_extract_all(template, F.lit(r"(\{\{\w+\}\})"), 1)
    said = F.transform(found, lambda t: F.coalesce(F.try_element_at(values, F.regexp_replace(t, r"[{}]", "")), t))
    return F.array_join(F.flatten(F.zip_with(F.split(template, r"\{\{\w+\}\}"), said, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def recorder_error(name: Column) -> Column:
    """What an error of a recorder means: denied, nodevice, busy or failed."""
    means = {"denied": ("NotAllowedError", "SecurityError"), "nodevice": ("NotFoundError", "OverconstrainedError"), "busy": ("NotReadableError", "AbortError")}
    return F.coalesce(*[F.when(name.isin(*names), code) for code, names in means.items()], F.lit("failed"))


def recorder_warnings(rate: Column, label: Column, kept: dict[str, Column]) -> Column:
    """Codes of what spoils a recording: ``narrow`` up to 16 kHz or else ``headset``, then the processing that stayed on."""
    said = F.lower(label)
    worn = said.contains("hands-free") | said.contains("airpods") | said.contains("headset")
    sound = F.when((rate > 0) & (rate <= 16000), "narrow").when(worn, "headset")
    return F.array_compact(F.array(sound, *[F.when(c, F.lit(n)) for n, c in kept.items()]))


def cache_fits(meta: dict[str, Column], wanted: dict[str, Column], frames: Column, calibrated: Column, size: Column) -> Column:
    """Whether a stored cache may be used: all wanted fields equal (nulls too), frames, a calibration and the right size.

    ``wanted`` has ``w2`` and ``h2``, the bytes of a frame.
    """
    same = F.lit(True)
    for name, c in wanted.items():
        same = same & meta[name].eqNullSafe(c)
    return same & F.coalesce((frames >= 1) & (size == frames * wanted["w2"] * wanted["h2"]), F.lit(False)) & F.coalesce(calibrated, F.lit(False))
