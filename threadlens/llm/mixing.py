"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Every document gets a number of copies drawn from a Poisson distribution whose
mean is the repetition rate of its source.  The draw inverts the distribution
function at a uniform number made from a hash of the seed and the document, so
it is the same in every run and under every partitioning.  The documents are
exploded by their counts and shuffled globally by a hash of document and copy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.session import materialize

from .common import bounded

#: The largest mean that is inverted in one step; a Poisson number of a larger mean is the sum of several.
STEP = 16.0
STEP_COUNTS = 80
BROADCAST_SOURCES = 100_000


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of a hash of the keys."""
    digits = F.substring(F.md5(F.concat_ws(":", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys)).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def cumulative(mean: Column) -> Column:
    """Array of P(X <= k) for k = 0 .. STEP_COUNTS - 1, for a mean of at most ``STEP``.

    The tail beyond is under 1e-25, far below the resolution of the uniform.
    """
    terms = F.transform(
        F.sequence(F.lit(0), F.lit(STEP_COUNTS - 1)),
        lambda k: F.exp(k * F.log(mean) - mean - F.element_at(F.array(*(F.lit(math.lgamma(i + 1)) for i in range(STEP_COUNTS))), k + 1)),
    )
    return F.aggregate(
        terms, F.array(F.lit(0.0)), lambda sums, t: F.concat(sums, F.array(F.element_at(sums, -1) + t)), lambda sums: F.slice(sums, 2, STEP_COUNTS)
    )


def drawn(u: Column, table: Column) -> Column:
    """Smallest k with P(X <= k) >= u."""
    return F.size(F.filter(table, lambda p: p < u))


def rates(docs: DataFrame, weights: DataFrame, key: str = "source", total: float | None = None) -> DataFrame:
    """(key, n, rate) per source: rate = weight share x total / n.

    ``weights`` has (key, weight).  Weights are shares of the sources that occur
    in ``docs``; a source without weight, or with a null or negative one, has
    rate 0 and leaves the mix.  ``total`` is the expected size of the mix, by
    default the number of documents.  A null source is a source like any other.
    """
    counts = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    given = weights.groupBy(F.col(key).alias("__key")).agg(F.sum(F.greatest(F.col("weight"), F.lit(0.0))).alias("weight"))
    held = materialize(
        counts.join(given, F.col(key).eqNullSafe(F.col("__key")), "left")
        .select(key, "n", F.coalesce("weight", F.lit(0.0)).alias("weight")), "sources",
    )
    sums = held.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).first()
    whole, size = sums["weight"] or 0.0, float(sums["n"] or 0) if total is None else float(total)
    share = F.col("weight") / whole if whole else F.lit(0.0)
    return held.select(key, "n", (share * size / F.col("n")).alias("rate"))


def mix(
    docs: DataFrame, source_rates: DataFrame, key: str = "source", id: str = "doc_id", seed: int = 1, columns: Sequence[str] = ()
) -> DataFrame:
    """The mixed documents in random order; ``columns`` may name ``__copy`` to keep the number of the copy.

    ``source_rates`` has (key, rate).  The hash of seed and ``id`` seeds the draw:
    rows with the same id (or a null one) draw the same count.  Means above
    ``STEP`` are drawn as a sum of independent parts, so large rates are exact too.
    Texts are never looked at: null and empty ones are mixed like any others.
    """
    parts = F.ceil(F.col("rate") / STEP).cast("int")
    r = source_rates.where("rate > 0").select(
        F.col(key).alias("__key"), parts.alias("__parts"), cumulative(F.col("rate") / parts).alias("__table")
    )
    r = bounded(materialize(r, "rates"), BROADCAST_SOURCES)
    names = docs.columns
    counts = F.aggregate(
        F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda n, i: n + drawn(uniform(F.lit(seed), F.col(id), i), F.col("__table"))
    )
    copies = (
        docs.join(r, F.col(key).eqNullSafe(F.col("__key"))).withColumn("__n", counts).where("__n > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
        .withColumn("__order", F.xxhash64(F.lit(seed), F.col(id), F.col("__copy")))
        .select(*names, "__copy", "__order")
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(n, "__order", "__copy").sortWithinPartitions("__order", "__copy").select(*names, *columns)


def smoothed(docs: DataFrame, key: str = "source", power: float = 0.5) -> DataFrame:
    """Target weights that flatten the sources: the number of documents to a power below 1."""
    return docs.groupBy(key).agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(power)).alias("weight"))
