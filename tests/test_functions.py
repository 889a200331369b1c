from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threadlens.functions import chars, clock, names, parts as P, redact, tokens


@pytest.fixture
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first()["v"]


def L(x):
    return F.lit(x)


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


@pytest.mark.parametrize("when", [datetime(2015, 1, 1), datetime(2019, 6, 30, 23, 59, 59, 999000), datetime(2023, 11, 19, 17, 52, 8)])
def test_snowflakes_round_trip(value, when):
    ms = round((when - datetime(2015, 1, 1)).total_seconds() * 1000)  # ids count from this day, shifted by 22 bits
    number = str((ms << 22) + 4097)
    if len(number) >= 17:
        assert value(clock.snowflake_to_ts(L(number))) == when
        assert value(clock.ts_to_snowflake(clock.snowflake_to_ts(L(number)))) == str(ms << 22)


@pytest.mark.parametrize("text, is_one", [("77", False), ("1234567890123456x8", False), (str((1 << 64) - 1), True)])
def test_what_is_no_snowflake(value, text, is_one):
    assert (value(clock.snowflake_to_ts(L(text))) is not None) == is_one


#: Every hour and some minutes of the clock, in both spellings of its half.
CLOCK_CASES = [
    (f"{month}/{day}/{year} {(hour + 11) % 12 + 1}:{minute:02d} {half}", datetime(year, month, day, hour, minute))
    for k, (year, month, day) in enumerate([(2024, 2, 29), (1999, 12, 31), (2023, 11, 5)])
    for hour in range(k, 24, 5)
    for minute, half in [(hour * 7 % 60, ("AM", "PM")[hour // 12]), (59, ("am", "pm")[hour // 12])]
]


@pytest.mark.parametrize("text, want", [
    *CLOCK_CASES[::3],
    ("2023-11-19T17:52:08Z", datetime(2023, 11, 19, 17, 52, 8)),
    ("2023-11-19T17:52:08.250-05:30", datetime(2023, 11, 19, 23, 22, 8, 250000)),
    ("yesterday", None), ("2023-13-01", None), ("", None),
])
def test_parse_timestamp(value, text, want):
    assert value(clock.parse_timestamp(L(text))) == want


def test_wall_clock_zone(value):
    assert value(clock.parse_timestamp(L("7/1/2023 11:45 PM"), "Asia/Kolkata")) == datetime(2023, 7, 1, 18, 15)
    assert value(clock.parse_title_time(L("Sunday, November 19, 2023 6:20 PM"))) == datetime(2023, 11, 19, 18, 20)


def test_labels(value):
    ts = L("2023-11-19 12:00:59").cast("timestamp")
    assert value(clock.clock_time(ts)) == "12:00 PM"
    assert value(clock.day_divider(ts)) == "Sunday, Nov 19, 2023"
    assert value(clock.http_date(ts)) == "Sun, 19 Nov 2023 12:00:59 GMT"
    assert value(clock.weekday(ts)) == 0
    steps = [(999, "[+0s]"), (45_000, "[+45s]"), (60_001, "[+1m]"), (3_599_999, "[+59m]"), (7_300_000, "[+2h]")]
    assert [value(clock.time_delta(L(ms))) for ms, _ in steps] == [text for _, text in steps]
    assert [value(clock.long_duration(L(ms))) for ms in (59_999, 2_460_000, 14_460_000)] == ["0m", "41m", "4h 1m"]


def test_utf16(value):
    assert value(chars.u16len(L("a👍"))) == 3
    assert value(chars.u16_clip(L("👍👍"), 3, "…")) == "👍…"
    assert value(chars.js_trim(L(" \t x 　\n"))) == "x"


def test_redaction_order(value):
    text = "see https://a.b/c?d=1] mail me@x.org call +1 555-123-4567"
    assert value(redact.redact(L(text), True, True)) == "see [URL] mail [EMAIL] call [PHONE]"
    assert value(redact.redact(L(text), True, False, redact.URL_STOP_TXT)).startswith("see [URL]] mail me@")
    assert value(redact.redact(L("(https://a.b)"), True, False, redact.URL_STOP_MARKDOWN)) == "([URL])"


def test_norm_text_is_the_same_for_all_formats(value):
    raw = value(P.norm_text(arr("> U1: q", "**Hi**  [there](https://x.y) :pog: 👍🏽 ^{🔥:1}", "[IMG: a.png]")))
    shown = value(P.norm_text(arr("Hi there")))
    assert raw.replace("🏽", "").strip() == shown == "hi there"


@pytest.mark.parametrize("text, want", [
    ("hello", 1), ("wonderful", 1), ("internationalization", 3), ("12345", 2), ("a  b", 3), ("a b", 2),
    ("a\n\n \nb", 3), ("漢字", 3), ("👍", 3), ("!!", 2), ("", 0),
])
def test_token_estimate(value, text, want):
    assert value(tokens.estimate_tokens(L(text))) == want


def test_budget_scalars(value):
    assert tokens.effective_budget(1000) == 1000
    assert tokens.effective_budget(11000) == 9500
    assert tokens.legend_reserve(3) == 320
    assert tokens.chars_for_tokens(10) == 26
    assert value(tokens.message_cost(arr("ab", "👍"))) == 14 + 5 + 5


def test_reaction_readings_differ_on_purpose(value):
    blob = L("👍:3, :custom:7, 🔥, x:0")

    def read(**kw):
        return [(e["emoji"], e["n"]) for e in value(P.reaction_entries(blob, **kw))]

    assert read() == [("👍", 3), ("🔥", 1), ("x", 1)]
    assert read(count_at="last") == [("👍", 3), (":custom", 7), ("🔥", 1), ("x", 1)]
    assert value(P.reaction_total(arr("t ^{👍:3, 🔥}", "^{a:b:4}"))) == 7


def test_parts(value):
    p = arr("> U1: hey", "> quote", "text ^{👍:1}", "[IMG: a.png]", "[NOTE]")
    assert value(P.plain_text(p)) == "text"
    assert value(P.media_count(p)) == 2
    assert value(P.media_types(p)) == ["IMG"]
    assert value(P.reply_target(p)) == "U1"
    assert value(P.last_blob(p)) == "👍:1"
    s = value(P.split_parts(p, L(True)))
    assert (s["reply"], s["lines"], s["reactions"]) == ("U1: hey", ["> quote", "text", "[IMG: a.png]", "[NOTE]"], ["{👍:1}"])
    assert value(P.split_parts(arr("> quote"), L(False)))["reply"] is None


def test_assemble_parts(value):
    def build(has_reply, parts, reactions):
        return value(P.assemble_parts(L("U1"), L(has_reply), L("snip"), parts, L(reactions).cast("string")))

    assert build(True, arr("hi"), "^{a:1}") == ["> U1: snip", "hi ^{a:1}"]
    assert build(False, arr("[IMG: x]"), "^{a:1}") == ["[IMG: x]", "^{a:1}"]
    assert build(False, arr(), "^{a:1}") == ["^{a:1}"]
    assert build(True, arr(), None) == ["> U1: snip"]


def test_names(value):
    assert value(names.username_similar(L("cheezy_mc0w0"), L("CHEEZY_mc0_0")))
    assert not value(names.username_similar(L("alice"), L("zorro")))
    assert value(names.username_similar(L(None).cast("string"), L("a"))) is False
    assert value(names.is_placeholder(L("Deleted_User_12")))
    assert not value(names.is_placeholder(L("unknown soldier")))
    assert value(names.author_bucket(L("U1"), 12)) == (ord("U") * 31 + ord("1")) % 12


def test_cells_and_file_names(value):
    assert value(redact.guard_formula(L("=1+1"))) == "'=1+1"
    assert value(redact.guard_formula(L("x=1"))) == "x=1"
    assert value(redact.safe_filename(L("..a/b:c. "))) == "a_b_c"
    assert value(redact.safe_filename(L("..."))) == "export"
    assert value(redact.escape_html(L("<a&\"'>"))) == "&lt;a&amp;&quot;&#39;&gt;"
