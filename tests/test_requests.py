"""Edge cases of request, release and name rules."""

import re

from pyspark.sql import functions as F

from skein.functions import requests as rules
from tests.test_rules import one

L = F.lit


def none():
    return F.lit(None).cast("string")


def test_wrapping_and_templates(spark):
    text = L("aa bbb cccc d  eeeeeeeeeeee f g h i j k l m n o p")
    assert one(spark, rules.wrapped(text, 6), rules.wrapped(none(), 6), rules.wrapped(L("  "), 6)) == (["aa bbb", "cccc d", "eeeeeeeeeeee"], ["Untitled"], ["Untitled"])
    long = one(spark, rules.wrapped(F.repeat(L("ab "), 20000), 5, most=2))
    assert long == (["ab ab", "ab ab"],)
    values = F.create_map(L("x"), L("{{y}}"), L("z"), none())
    assert one(spark, rules.fill(L("a {{x}} b {{y}}{{x}}"), values), rules.fill(L(""), values), rules.fill(none(), values), rules.fill(L("{{z}}"), values)) == ("a {{y}} b {{y}}{{y}}", "", None, "{{z}}")


def test_sections(spark):
    log = L("# t\r\n## 1.2\n\n- a\n- b\n\n## 1.1\nold\n## 1.0")
    assert one(spark, *[rules.section_of(log, L(v)) for v in ("1.2", "1.1", "1.0", "9")], rules.section_of(none(), L("1"))) == ("- a\n- b", "old", None, None, None)


def test_headers_and_names(spark):
    got = one(spark, rules.disposition(L('ü a"b+(1)*~!.pdf')), rules.latin(L("“a”  – é 日")), rules.page_key(L("s"), L(12345)), rules.page_key(L("s"), L(7)))
    assert got == ("attachment; filename=\"_ a'b+(1)*~!.pdf\"; filename*=UTF-8''%C3%BC%20a%22b%2B(1)*~!.pdf", '"a" - é', "s:12345", "s:0007")
    made = one(spark, rules.new_id(L(1717243200000)))[0]
    assert made.startswith("lww29hc0-") and re.fullmatch(rules.ID.replace(r"\z", r"\Z"), made)


def test_latin(spark):
    said = ["‘a’ ‚b‛", "“a” „b‟ 「c」『d』 «e»", "a–b—c‐d－e", "【a】［b］〈c〉（d）", "ＡＢｃ１！", "a\u3000\u00a0 b\u2028c", "日本 é ﬁ 😀x", "", None]
    want = ("'a' 'b'", '"a" "b" "c""d" «e»', "a-b-c-d-e", "[a][b][c](d)", "ABc1!", "a b c", "é x", "", None)
    assert one(spark, *[rules.latin(L(x).cast("string")) for x in said]) == want


def test_hosts_and_refusals(spark):
    assert one(spark, *[rules.origin_host(L(o).cast("string")) for o in ("HTTPS://u@Ex.com:443/x", "http://a:81", "http://a:80?q", "null", "", None)]) == ("ex.com", "a:81", "a", None, None, None)
    ask = lambda *h, **k: rules.refusal(*[L(x).cast("string") for x in h], allowed=["a"], **k)
    got = one(spark, ask("A", None, None, "GET", None), ask(None, None, None, "GET", None), ask("b", None, "http://b", "GET", None, local=False), ask("a", None, None, "POST", None),
              ask("b", None, "x", "GET", None, local=False), ask("a", "none", "http://A:80/", "POST", "application/json ; q"))
    assert got == (None, "403 host", None, "415 type", "403 bad origin", None)


def test_claims_and_caches(spark):
    n = L(None).cast("int")
    wait = lambda *x: rules.takeover_wait(*x)
    assert one(spark, wait(L("a"), L("b"), L(5), L("c"), n, L(12)), wait(L("a"), none(), n, none(), n, L(12)), wait(L("a"), L("a"), L(5), L("c"), n, L(880)), wait(L("a"), L("b"), L(0), L("c"), n, L(900))) == (5, None, 30, None)
    want = {"w2": L(2), "h2": L(3), "crop": none()}
    fits = lambda meta, frames, size: rules.cache_fits({**want, **meta}, want, L(frames).cast("int"), L(True), L(size))
    assert one(spark, fits({}, 2, 12), fits({}, 2, 13), fits({}, 0, 0), fits({}, None, 0), fits({"crop": L("x")}, 2, 12)) == (True, False, False, False, False)


def test_assets(spark):
    files = F.array(L("a-x64.exe"), L("a-ARM64.dmg"), L("a.dmg"), none(), L("a_amd64.deb"), L("a-arm64.dmg.zip"))
    got = one(spark, *[rules.pick_asset(files, p, a) for p, a in (("win32", True), ("darwin", True), ("darwin", False), ("linux", True), ("linux", False), ("plan9", True))])
    assert got == ("a-x64.exe", "a-ARM64.dmg", "a.dmg", None, "a_amd64.deb", None)
    assert one(spark, rules.pick_asset(F.array(L("b.exe"), L("b-arm64.EXE")), "win32", True), rules.pick_asset(F.array(L("b-arm64.exe")), "win32")) == ("b-arm64.EXE", None)


def test_recorders(spark):
    names = ("SecurityError", "OverconstrainedError", "NotReadableError", "TypeError", None)
    assert one(spark, *[rules.recorder_error(L(x).cast("string")) for x in names]) == ("denied", "nodevice", "busy", "failed", "failed")
    kept = {"echo": L(True), "gain": L(None).cast("boolean")}
    warn = lambda rate, label: rules.recorder_warnings(L(rate).cast("int"), L(label).cast("string"), kept)
    assert one(spark, warn(16000, "A HEADSET"), warn(16001, "Hands-Free"), warn(0, None), warn(None, "mic")) == (["narrow", "echo"], ["headset", "echo"], ["echo"], ["echo"])
