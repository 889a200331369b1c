"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base spans are found by four patterns.  They are the seeds: the words beside a
seed form lexical patterns, and patterns and the identifiers they hold form a
bipartite graph.  In every round a pattern is scored by the share of its
identifiers that are known to be of a kind, an identifier by the patterns that
hold it, and identifiers whose score is high enough become known.  At last the
high-confidence patterns give spans to identifiers that no base pattern matches.

An identifier is a run of tokens with a digit or an at sign.  The graph's edges
are distinct (pattern, identifier) pairs, counted before anything is joined, and
only patterns above the thresholds take part in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.session import materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.8
MIN_SCORE = 0.8
CONTEXT = 80

# Java's loops over groups recurse unless they are possessive, so those that end a
# pattern or stand before a character they can't match are; nothing else differs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IDENTIFIER = r"(?<!\S)(?=\S*?[0-9@])\S++(?:\x20\(?[0-9][0-9().-]*+(?!\S))*+"


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before>> of the matches; code points, ``before`` is the text since the last match."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    step = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    kind = "array<struct<start:int,end:int,value:string,before:string>>"

    def add(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["gap"])
        end = start + F.length(m["value"])
        span = F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"), m["gap"].alias("before"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.aggregate(step, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans")), add, lambda s: s["spans"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def is_ip(value: Column) -> Column:
    """Every part is at most 255, leading zeros or not."""
    return F.forall(F.split(value, r"\."), lambda p: F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 3, "0").between("000", "255") & (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3))


def is_card(value: Column) -> Column:
    """16 to 19 digits whose Luhn sum is a multiple of ten."""
    d = F.reverse(digits(value))
    places = F.sequence(F.lit(1), F.least(F.length(d), F.lit(19)))
    total = F.aggregate(places, F.lit(0), lambda total, k: total + luhn_digit(F.substring(d, k, F.lit(1)).cast("int"), k))
    return F.length(d).between(16, 19) & (total % 10 == 0)


def luhn_digit(digit: Column, place: Column) -> Column:
    twice = digit * 2
    return F.when(place % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)


def is_phone(value: Column) -> Column:
    return F.length(digits(value)).between(8, 15)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> in the order of kinds, then of starts; guards keep plain texts cheap."""
    has_digit = text.rlike("[0-9]")
    parts = []
    for kind, pattern, guard, test in (
        ("email", EMAIL, text.contains("@"), None), ("ip", IP, has_digit & text.contains("."), is_ip),
        ("card", CARD, has_digit, is_card), ("phone", PHONE, has_digit & text.contains("+"), is_phone),
    ):
        parts.append(F.when(guard, of_kind(kind, found(text, pattern), test)).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    return F.concat(*parts)


def of_kind(kind: str, spans: Column, test) -> Column:
    if test is not None:
        spans = F.filter(spans, lambda s: test(s["value"]))
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def identifiers(text: Column) -> Column:
    """Runs of tokens with a digit or an at sign, with the text before and the word behind each."""
    return F.when(text.rlike("[0-9@]"), found(text, IDENTIFIER))


def occurrences(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end, identifier, patterns, kind) of every identifier.

    ``kind`` is that of a base span that overlaps it, or null.  Quotes, brackets
    and full stops around an identifier are not part of it, and what stands
    before an equals sign or colon in the same token belongs to its left context.
    """
    core = r"^((?:[^\s=:]{0,40}[=:])?[\"'(\[{<]*)(.*?)[\"')\]}>,.;:!?]*$"
    each = rows.select("doc_id", "text_hash", "base", F.explode("ids").alias("id"))
    each = each.select(
        "doc_id", "text_hash", "base", F.col("id.before").alias("before"), F.col("id.start").alias("from"),
        F.regexp_extract("id.value", core, 1).alias("head"), F.regexp_extract("id.value", core, 2).alias("identifier"),
    ).where("identifier <> ''")
    start = F.col("from") + F.length("head")
    each = each.withColumn("start", start).withColumn("end", F.col("start") + F.length("identifier"))
    hit = F.filter("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    left = F.lower(F.concat(F.substring("before", -CONTEXT, CONTEXT), F.col("head")))
    words = F.filter(F.split(left, r"[^\p{L}]+"), lambda w: w != "")
    last, two = F.element_at(words, -1), F.array_join(F.slice(F.concat(F.array(F.lit(""), F.lit("")), words), -2, 2), " ")
    sort = (
        F.when(F.col("identifier").contains("@"), "at").when(F.col("identifier").rlike("[A-Za-z]"), "mixed").otherwise("digits")
    )
    kinds = F.concat_ws("|", F.lit("1"), last, sort), F.concat_ws("|", F.lit("2"), two, sort)
    return each.select(
        "doc_id", "text_hash", "start", "end", F.lower("identifier").alias("identifier"),
        F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) == 1, F.array(kinds[0])).otherwise(F.array(*kinds)).alias("patterns"),
        F.when(F.size(hit) > 0, hit[0]["kind"]).alias("kind"),
    )


def bootstrap(each: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that pass in the last round.

    A pattern's confidence for a kind is the share of known identifiers of the
    kind among all distinct identifiers it holds, and it needs ``MIN_SEEDS`` of
    them.  An identifier's score is 1 less the product of its patterns' doubts.
    """
    edges = materialize(
        each.select("identifier", "kind", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "identifier").agg(F.max("kind").alias("kind")), "pattern-graph",
    )
    known = materialize(edges.where("kind IS NOT NULL").groupBy("identifier").agg(F.max("kind").alias("known"), F.lit(1.0).alias("score")), "known")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    good = None
    for _ in range(rounds):
        held = (
            edges.join(known, "identifier").groupBy("pattern", F.col("known").alias("pattern_kind"))
            .agg(F.count(F.lit(1)).alias("seeds"), F.sum("score").alias("mass")).where(F.col("seeds") >= MIN_SEEDS)
        )
        good = materialize(
            held.join(sizes, "pattern").withColumn("confidence", F.col("mass") / F.col("n"))
            .where(F.col("confidence") >= MIN_CONFIDENCE).select("pattern", "pattern_kind", "confidence"), "good-patterns",
        )
        scored = (
            edges.where("kind IS NULL").join(good, "pattern").groupBy("identifier", "pattern_kind")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("score"))
            .where(F.col("score") >= MIN_SCORE)
            .groupBy("identifier").agg(F.max(F.struct("score", F.col("pattern_kind").alias("known"))).alias("best"))
            .select("identifier", F.col("best.known").alias("known"), F.col("best.score").alias("score"))
        )
        seeds = known.where("score = 1.0")
        known = materialize(seeds.unionByName(scored.join(seeds.select("identifier"), "identifier", "left_anti")), "known")
    return good


def extract(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, base, spans) of every row: the base spans, and all spans.

    Spans are array<struct<kind, start, end>> in code points, end exclusive, by
    kind in the fixed order, then by start.  A null text is empty.  An added span
    never overlaps a base one.  Repeated rows give equal results.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(id).alias("doc_id"), t.alias("t"))
    rows = materialize(
        source.select("doc_id", F.xxhash64("t").alias("text_hash"), base_spans(F.col("t")).alias("base"), identifiers(F.col("t")).alias("ids")),
        "personal-data",
    )
    each = materialize(occurrences(rows), "identifiers")
    good = bootstrap(each)
    plausible = (F.length(digits(F.col("identifier"))) >= 4) | F.col("identifier").contains("@")
    added = (
        each.where(F.col("kind").isNull() & plausible)
        .select("doc_id", "text_hash", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern")
        .groupBy("doc_id", "text_hash", "start", "end")
        .agg(F.max(F.struct("confidence", "pattern_kind")).alias("best"))
        .select("doc_id", "text_hash", F.struct(F.col("best.pattern_kind").alias("kind"), "start", "end").alias("span"))
        .groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_list("span").alias("added"))
    )
    added = materialize(added, "added-spans")
    both = F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    return rows.join(added, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left").select(
        F.col("doc_id").alias(id), "text_hash", "base", in_order(both).alias("spans")
    )


def in_order(spans: Column) -> Column:
    return F.concat(*(F.array_sort(only(spans, kind)) for kind in KINDS))


def only(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(only(spans, kind)).cast("long")
