"""Line near-dedup by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are near if one edit of a whole word (inserted, deleted or replaced)
turns one into the other.  A line and its neighbours then share a variant with
one word deleted: a replaced word leaves the same variant with the same word
missing, and an inserted one leaves the other line itself.  So each line emits
its variants as hashed keys; equal keys join; the candidates are verified word by
word; and a line goes if an earlier one is equal or near.

A variant's key is a sum of hashes of (word, place), with the places behind the
gap moved up, so all variants of a line follow from running sums and their number
is that of its words.  Before that a filter that loses nothing keeps the lines
that can have a neighbour at all: one edit leaves the first or the second half of
a line unchanged, so a line that shares neither half with a line of the same
length (or of one word less) has none.

A line in a group of equal keys is compared with the earliest of the group only,
which settles whether any earlier one exists, so groups are never expanded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.session import drop_layer, materialize

from .common import BROADCAST_ROWS, bounded

MIN_WORDS = 5


def numbered_lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, line_no, line) of every line, white space squeezed to single blanks; '' if it has no word."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    raw = F.col("raw")
    # Most lines are squeezed already; looking for what is not costs less than a pattern.
    odd = reduce(Column.__or__, (raw.contains(c) for c in ("  ", "\t", "\r", "\f", "\x0b")))
    line = F.trim(F.when(odd, F.regexp_replace(raw, r"\s+", " ")).otherwise(raw))
    return docs.select(F.col(id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(split).alias("line_no", "raw")).select(
        "doc_id", "text_hash", "line_no", line.alias("line")
    ).withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(7), "line")})


def word_count(line: Column) -> Column:
    """Words of a squeezed line that is not empty."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def place(doc_id: str = "doc_id", text_hash: str = "text_hash", line_no: str = "line_no") -> Column:
    """Where a line stands; null ids come last."""
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), F.col(text_hash).alias("text_hash"), F.col(line_no).alias("line_no"))


def half_keys(line: str, n: str) -> list[Column]:
    """Keys of the first and the second half of a line of ``n`` words, for its own length and for one word less."""
    keys = []
    for length in (n, f"({n} - 1)"):
        head = f"int({length} div 2)"
        keys.append(F.expr(f"xxhash64(0, {length}, substring_index({line}, ' ', {head}))"))
        keys.append(F.expr(f"xxhash64(1, {length}, substring_index({line}, ' ', {head} - {length}))"))
    return keys


HALVES = ("k0", "k1", "k2", "k3")


def with_partner(firsts: DataFrame) -> DataFrame:
    """Hashes of the lines that share a half with a different line."""
    keys = firsts.where("k0 IS NOT NULL").select("h", F.explode(F.array(*HALVES)).alias("key"))
    shared = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("key")
    shared = materialize(shared, "shared-halves")
    partners = materialize(keys.join(bounded(shared, BROADCAST_ROWS), "key", "left_semi").select("h").distinct(), "lines-with-partner")
    drop_layer(shared)
    return partners


def variants(lines: DataFrame) -> DataFrame:
    """(line_id, n, gap, key): each line whole (gap 0) and with each of its words deleted (gap = its place).

    The hashes of (word, place) are added up in two halves of 32 bits, whose sums
    are exact for lines of up to 2**31 words.  A line is dealt out before it is
    exploded, so its words need not move again to be added up.
    """
    at = F.col("at")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exploded = (
        lines.repartition(parts, "line_id")
        .select("line_id", "n", F.posexplode("words").alias("at", "word")).withColumn("at", at + 1)
        .select("line_id", "n", "at", F.xxhash64("word", at).alias("here"), F.xxhash64("word", at - 1).alias("moved"))
    )
    line = Window.partitionBy("line_id")
    so_far = line.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    whole_key, gap_key = [], []
    for part in (lambda c: F.shiftrightunsigned(c, 32), lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))):
        here, moved = part("here"), part("moved")
        before = F.sum(here).over(so_far)
        behind = F.sum(moved).over(line) - F.sum(moved).over(so_far)
        gap_key.append(before - here + behind)
        whole_key.append(before)
    # The key so far at the last word is that of the whole line.
    keyed = exploded.select(
        "line_id", "n", "at", F.xxhash64(*gap_key).alias("key"), F.when(at == F.col("n"), F.xxhash64(*whole_key)).alias("whole")
    )
    gaps = F.array(F.struct(at.alias("gap"), F.col("key").alias("key")))
    both = F.when(F.col("whole").isNull(), gaps).otherwise(F.concat(gaps, F.array(F.struct(F.lit(0).alias("gap"), F.col("whole").alias("key")))))
    return keyed.select("line_id", "n", F.explode(both).alias("v")).select("line_id", "n", "v.gap", "v.key")


def equal_but_for(a: Column, b: Column, gap: Column) -> Column:
    """Both arrays are as long and differ at most at place ``gap``."""
    ahead, behind = F.greatest(gap - 1, F.lit(0)), F.lit(1 << 30)
    return (
        (F.size(a) == F.size(b)) & (F.slice(a, F.lit(1), ahead) == F.slice(b, F.lit(1), ahead))
        & (F.slice(a, gap + 1, behind) == F.slice(b, gap + 1, behind))
    )


def equal_without(a: Column, b: Column, gap: Column) -> Column:
    """``a`` without its word at place ``gap`` is ``b``."""
    return (F.size(a) == F.size(b) + 1) & (F.slice(a, F.lit(1), gap - 1) == F.slice(b, F.lit(1), gap - 1)) & (
        F.slice(a, gap + 1, F.lit(1 << 30)) == F.slice(b, gap, F.lit(1 << 30))
    )


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, line_no) of the lines that go.

    Lines are compared by their words, so white space is no difference.  Lines of
    fewer than ``min_words`` words go only if an earlier one is equal: one word
    would be too much of them.  Blank lines never go.  Earlier means a smaller
    document id (null ids last), then text hash, then line number; rows that
    repeat with the same id and text are one document.
    """
    rows = numbered_lines(docs, id, text)
    counted = rows.withColumn("n", word_count(F.col("line")).cast("int"))
    keys = [F.when(F.col("n") >= min_words, key).alias(name) for name, key in zip(HALVES, half_keys("line", "n"), strict=True)]
    places = materialize(counted.where("line <> ''").select("doc_id", "text_hash", "line_no", "h", "g", *keys), "line-places")
    firsts = places.groupBy("h", "g").agg(F.min(place()).alias("first"))
    partners = with_partner(places)
    # Numbered in the order of their first places, so a smaller number is an earlier line.
    chosen = (
        rows.join(bounded(partners, BROADCAST_ROWS), "h", "left_semi")
        .groupBy("h", "g").agg(F.min(place()).alias("first"), F.any_value("line").alias("line"))
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = materialize(
        chosen.repartitionByRange(parts, "first").sortWithinPartitions("first")
        .select(F.monotonically_increasing_id().alias("line_id"), "h", "g", F.split("line", " ").alias("words"))
        .withColumn("n", F.size("words")), "distinct-lines",
    )
    keyed = materialize(variants(chosen), "line-variants")
    near = materialize(
        chosen.select("line_id", "h", "g").join(near_earlier(keyed, chosen), "line_id", "left_semi").select("h", "g", F.lit(True).alias("near")),
        "near-lines",
    )
    for layer in (partners, keyed, chosen):
        drop_layer(layer)
    return (
        places.drop(*HALVES).join(firsts, ["h", "g"]).join(bounded(near, BROADCAST_ROWS), ["h", "g"], "left")
        .where(F.coalesce("near", F.lit(False)) | (place() > F.col("first"))).select("doc_id", "text_hash", "line_no")
    )


def near_earlier(keyed: DataFrame, chosen: DataFrame) -> DataFrame:
    """Ids of the lines that have an earlier line at one edit; ids rise with the lines' places."""
    deleted, whole = keyed.where("gap > 0"), keyed.where("gap = 0")
    # Replaced: same length, same gap, same rest.  The earliest of the group stands for all.
    earliest = deleted.groupBy("n", "gap", "key").agg(F.min("line_id").alias("other"), F.max("line_id").alias("last")).where("other < last")
    replaced = (
        deleted.join(earliest.drop("last"), ["n", "gap", "key"]).where("other < line_id")
        .select("line_id", "other", "gap", F.lit("replaced").alias("edit"))
    )
    # Inserted or deleted: the longer line's variant is the shorter line.
    longer = deleted.select((F.col("n") - 1).alias("n"), "key", F.col("line_id").alias("long"), "gap")
    pair = longer.join(whole.select("n", "key", F.col("line_id").alias("short")), ["n", "key"])
    later_long = pair.where("short < long").select(F.col("long").alias("line_id"), F.col("short").alias("other"), "gap", F.lit("longer").alias("edit"))
    # A short line may be the rest of very many longer ones; the earliest settles it.
    later_short = (
        pair.where("long < short").groupBy("short").agg(F.min(F.struct("long", "gap")).alias("head"))
        .select(F.col("short").alias("line_id"), F.col("head.long").alias("other"), F.col("head.gap").alias("gap"), F.lit("shorter").alias("edit"))
    )
    edges = replaced.union(later_long).union(later_short).distinct()
    own = chosen.select("line_id", F.col("words").alias("a"))
    others = chosen.select(F.col("line_id").alias("other"), F.col("words").alias("b"))
    a, b, gap = F.col("a"), F.col("b"), F.col("gap")
    right = (
        F.when(F.col("edit") == "replaced", equal_but_for(a, b, gap)).when(F.col("edit") == "longer", equal_without(a, b, gap))
        .otherwise(equal_without(b, a, gap))
    )
    return edges.join(own, "line_id").join(others, "other").where(right).select("line_id").distinct()


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text that stays and (n_lines, n_dropped), which replace columns of these names.

    Null texts stay null and have no lines.  The lines of a text that go are
    listed per document and taken out of it in place.
    """
    gone = (
        repeated_lines(docs, id, text, min_words)
        .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("__gone"))
        .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__gone")
    )
    gone = materialize(gone, "gone-lines")
    split = F.split(F.col(text), "\n")
    kept = F.filter(split, lambda line, at: ~F.array_contains("__gone", at))
    return (
        docs.join(gone, F.col(id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__hash")), "left")
        .withColumn("n_lines", F.coalesce(F.size(split), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
        .withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
        .select(*(c for c in docs.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")
    )
