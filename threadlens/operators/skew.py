"""Joins against a dimension when one key may hold much of the fact side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000
SALTS = 64


def join_dimension(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join ``dim`` (one row per key) to ``facts``, splitting hot keys.

    Keys with more than ``hot_rows`` fact rows are found by a partial
    aggregation; there are at most rows / ``hot_rows`` of them.  Only their
    dimension rows are repeated, once per salt, and only their fact rows are
    spread, by a hash of the columns in ``spread``.  A key gets ``salts`` salts,
    or more if they would hold more than ``hot_rows`` rows each.  Every other key keeps
    salt 0.  Rows without a key match nothing, but a shuffle deals them out like
    one key; where they are as many, they are spread with no limit to the salts.
    When no key is hot the join is the plain one, which AQE broadcasts
    if the dimension turns out small.

    ``counted`` has the same keys as ``facts`` where those are dear to compute twice.
    """
    keys = list(keys)
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    counts = (facts if counted is None else counted).groupBy(*keys).count().where(F.col("count") > hot_rows)
    kinds = {r[0] for r in counts.select(known).distinct().collect()}
    if not kinds:
        return facts.join(dim, keys, how)

    needed = F.greatest(F.lit(salts).cast("bigint"), F.ceil(F.col("count") / hot_rows))
    hot = counts.where(known).select(*keys, needed.alias("__salts"))

    def marked(df: DataFrame) -> DataFrame:
        df = df.join(hot, keys, "left") if True in kinds else df.withColumn("__salts", F.lit(None).cast("bigint"))
        return df.withColumn("__salts", F.coalesce("__salts", F.lit(1).cast("bigint")))

    place = F.xxhash64(*spread)
    salt = F.when(known, F.pmod(place, F.col("__salts"))).otherwise(place)
    left = marked(facts).withColumn("__salt", salt).drop("__salts")
    copies = F.sequence(F.lit(0).cast("bigint"), F.col("__salts") - 1)
    right = marked(dim).withColumn("__salt", F.explode(copies)).drop("__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
