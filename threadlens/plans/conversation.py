"""From export files to one conversation, its statistics and its exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import day_edge
from ..operators import analytics, budget, filters, identity, merge, sequences
from ..operators.ordered import MAX_GROUP_ROWS
from ..schema import RAW_MESSAGE
from ..session import materialize
from ..sources import catalog, html_export, json_export, txt_export
from .options import Options


@dataclass(frozen=True)
class Conversation:
    files: DataFrame
    raw: DataFrame
    people: DataFrame
    messages: DataFrame


HEADER_COLUMNS = ("file_id", "channel_id", "base_name", "after_date", "exported_at", "invalid", "error")


def read_exports(
    spark: SparkSession, path: str, options: Options = Options(), mapping: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """All export files below ``path`` as ``(files, raw_messages)``.

    An invalid file stays in ``files`` with its error and adds no messages.  Each
    format is one scan of the folder that takes its own files; superseded uploads
    leave with the join to ``files``, so no list of paths reaches the driver.
    """
    listed = catalog.latest_uploads(catalog.with_format(catalog.list_files(spark, path)))
    listed = materialize(listed, "files")
    if listed.isEmpty():
        raise ValueError(f"no export files below {path}")
    kind = catalog.format_of(F.col("file_id"))
    json_heads, elements = json_export.read(spark, path, where=kind == "json")
    lines = txt_export.read_lines(spark, path).where(kind == "txt")
    boxes = html_export.markup(html_export.read_fragments(spark, path).where(kind == "html"))
    found = boxes.select("file_id", F.lit(True).alias("found")).distinct()
    error = F.when(F.col("found").isNull(), "No messages found")
    html_heads = catalog.html_names(listed.where("format = 'html'")).join(found, "file_id", "left").select(
        "file_id", "channel_id", "base_name", "after_date",
        F.lit(None).cast("timestamp").alias("exported_at"), error.isNotNull().alias("invalid"), error.alias("error"),
    )
    heads = [json_heads, txt_export.headers(lines), html_heads]
    bodies = [
        json_export.to_raw_messages(elements), txt_export.scan(lines, options.txt_timezone),
        html_export.to_raw_messages(boxes, options.txt_timezone),
    ]
    head, body = heads[0], bodies[0]
    for other in heads[1:]:
        head = head.unionByName(other)
    for other in bodies[1:]:
        body = body.unionByName(other)
    files = listed.join(head.select(*HEADER_COLUMNS), "file_id", "left").withColumn(
        "invalid", F.coalesce("invalid", F.lit(True))
    )
    if mapping is not None:
        files = catalog.remap_channels(files, mapping)
    files = materialize(catalog.number_files(files), "files")
    valid = files.where(~F.col("invalid")).select("file_id", "file_idx", "grp_file_idx", "channel_id")
    raw = body.join(valid, "file_id").select(*[F.col(f.name).cast(f.dataType) for f in RAW_MESSAGE.fields])
    return files, raw


def build_messages(
    raw: DataFrame,
    files: DataFrame | None = None,
    use_real_names: bool = False,
    max_rows: int = MAX_GROUP_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """``(people, messages)``: identity over everything, then the merge per channel.

    Intermediate layers are written out: each is read by several later steps.
    """
    raw = materialize(raw, "raw")
    who = identity.build_identity(raw, files, use_real_names, max_rows)
    msgs = materialize(merge.prepare(identity.assemble(raw, who)), "assembled")
    msgs = merge.anchor_clocks(msgs, max_rows)
    msgs = materialize(msgs, "anchored")
    msgs = merge.apply_bridge(msgs, merge.content_bridge(msgs))
    msgs = materialize(msgs, "bridged")
    msgs = merge.label_authors(merge.resolve_reply_targets(msgs), who.people)
    msgs = materialize(msgs, "labelled")
    return who.people, materialize(merge.dedup(msgs, max_rows), "messages")


def load(spark: SparkSession, path: str, options: Options = Options(), mapping=None) -> Conversation:
    files, raw = read_exports(spark, path, options, mapping)
    people, messages = build_messages(raw, files, options.use_real_names)
    return Conversation(files, raw, people, messages)


def apply_filters(msgs: DataFrame, people: DataFrame, o: Options) -> DataFrame:
    """Date, bots, system, media-only and people filters, in this order."""
    spark = msgs.sparkSession
    start = day_edge(F.lit(o.date_from), False, o.tz) if o.date_from else None
    end = day_edge(F.lit(o.date_to), True, o.tz) if o.date_to else None
    out = filters.in_date_range(msgs, start, end)
    if o.bots:
        out = filters.drop_bots(out, spark.createDataFrame([(b,) for b in o.bots], "name string"))
    if o.drop_system:
        out = filters.drop_system(out)
    if o.drop_media_only:
        out = filters.drop_media_only(out)
    if o.users:
        labels = spark.createDataFrame([(u,) for u in o.users], "label string")
        out = filters.keep_authors_by_label(out, labels, people)
    if o.user_ids:
        out = filters.keep_authors_by_id(out, spark.createDataFrame([(u,) for u in o.user_ids], "uid string"))
    return out


def process(msgs: DataFrame, people: DataFrame, o: Options = Options()) -> budget.Trimmed:
    """Filtered and trimmed to the budget, per channel."""
    filtered = materialize(apply_filters(msgs, people, o), "filtered")
    return budget.trim(
        filtered,
        people,
        max_tokens=o.max_tokens if o.count_tokens else None,
        max_chars=o.max_chars,
        keywords=o.keywords,
        min_messages=o.min_messages,
        counter=o.counter,
    )


def analyze(msgs: DataFrame, people: DataFrame, o: Options = Options()) -> dict[str, DataFrame]:
    """Statistics of the full filtered conversation, one DataFrame each."""
    e = materialize(analytics.enrich(apply_filters(msgs, people, o), o.tz), "enriched")
    return {
        "enriched": e,
        "totals": analytics.totals(e),
        "heatmap": analytics.heatmap(e),
        "timeline": analytics.timeline(e),
        "users": analytics.user_stats(e),
        "reactions": analytics.reaction_totals(e),
        "media": analytics.media_breakdown(e),
        "reply_edges": analytics.reply_edges(e),
        "recap": sequences.recap(e),
        "day_index": sequences.day_index(e),
    }
