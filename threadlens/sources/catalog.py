"""The table of export files: listing, naming, grouping, superseding."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.chars import non_empty
from ..operators.ordered import MAX_GROUP_ROWS, row_numbers, slice_groups

# A file of this many bytes read as one block starts new blocks at these
# offsets; positions inside a file are block start plus row, which is strictly
# increasing because every row is at least one byte long.
ROW_MASK = (1 << 33) - 1


def list_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Path, name, size and time of every file, without reading contents.

    ``key`` is the path below the given root: an upload supersedes another of
    the same key, and equal names in different folders are different files.
    """
    m = "_metadata"

    def below(root: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        return files.select(
            F.col(f"{m}.file_path").alias("file_id"),
            _decoded(F.col(f"{m}.file_name")).alias("name"),
            F.substring_index(_decoded(F.col(f"{m}.file_path")), root.rstrip("/").split(":", 1)[-1] + "/", -1).alias("key"),
            F.col(f"{m}.file_size").alias("size"),
            F.unix_millis(F.col(f"{m}.file_modification_time")).alias("sort_order"),
        )

    return reduce(DataFrame.unionByName, map(below, paths))


def _decoded(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def format_of(name: Column) -> Column:
    """``json`` and ``txt`` by extension, anything else is read as ``html``."""
    low = F.lower(name)
    return F.when(low.endswith(".txt"), "txt").when(low.endswith(".json"), "json").otherwise("html")


def with_format(files: DataFrame) -> DataFrame:
    return files.withColumn("format", format_of(F.col("name")))


def loadable(file_id: str) -> str:
    """A file's metadata path as a path to load: decoded, glob characters escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(file_id))


def html_names(files: DataFrame) -> DataFrame:
    """``name [id] (after YYYY-MM-DD).html`` taken apart; else the name itself."""
    name = F.col("name")
    dated = r"(?i)^(.+\[(\d+)\])\s*\(after (\d{4}-\d{2}-\d{2})\)\.html$"
    plain = r"(?i)^(.+\[(\d+)\])\.html$"
    is_dated, is_plain = name.rlike(dated), name.rlike(plain)

    def pick(i: int, fallback):
        return (
            F.when(is_dated, F.regexp_extract(name, dated, i))
            .when(is_plain, F.regexp_extract(name, plain, i))
            .otherwise(fallback)
        )

    after = F.when(is_dated, F.regexp_extract(name, dated, 3))
    return files.withColumns(
        {
            "channel_id": pick(2, name),
            "base_name": F.trim(pick(1, F.regexp_replace(name, r"(?i)\.html$", ""))),
            "after_date": after,
        }
    )


def latest_uploads(files: DataFrame) -> DataFrame:
    """Drop repeats and superseded files: the newest of each key (or name, without keys) stays.

    ``row_number() = 1`` is cut before the shuffle, so a file uploaded very
    often does not gather in one task.
    """
    w = W.partitionBy("key" if "key" in files.columns else "name").orderBy(F.desc("sort_order"), F.desc("size"), "file_id")
    return files.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def number_files(files: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Global ``file_idx`` and ``grp_file_idx`` inside the channel, from 0."""
    o = row_numbers(slice_groups(files, [], ["sort_order", "file_id"], max_rows), "__i")
    files = o.result().withColumn("file_idx", (F.col("__i") - 1).cast("int")).drop("__i")
    o = slice_groups(files, ["channel_id"], ["sort_order", "file_idx"], max_rows)
    o = row_numbers(o, "__i")
    return o.result().withColumn("grp_file_idx", (F.col("__i") - 1).cast("int")).drop("__i")


def merge_groups(files: DataFrame, channel_ids: Sequence[str]) -> DataFrame:
    """Re-key the chosen channels onto the first one, with its base name."""
    if len(channel_ids) < 2:
        return files
    target = channel_ids[0]
    first = files.where(F.col("channel_id") == target).agg(
        F.min_by("base_name", "file_id").alias("b")
    )
    base = first.first()["b"] or "Merged"
    chosen = F.col("channel_id").isin(*channel_ids)
    return files.withColumn(
        "base_name", F.when(chosen, F.lit(base)).otherwise(F.col("base_name"))
    ).withColumn("channel_id", F.when(chosen, F.lit(target)).otherwise(F.col("channel_id")))


def remap_channels(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """Re-key channels by a table ``from_id, to_id``."""
    m = mapping.select(F.col("from_id").alias("channel_id"), "to_id")
    return (
        files.join(m, "channel_id", "left")
        .withColumn("channel_id", F.coalesce("to_id", "channel_id"))
        .drop("to_id")
    )


def join_names(*pieces, sep: str = " - "):
    """Concatenate what is present; blanks count as absent."""
    return F.concat_ws(sep, *[non_empty(p) for p in pieces])
