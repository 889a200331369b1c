"""Reply network, reply partners and the top reply duo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_NODES = 28  # fixed value: people shown in the network
MIN_PAIR_REPLIES = 3  # fixed value: noise floor of a pair
PARTNERS = 5  # fixed value


def reply_pairs(edges: DataFrame) -> DataFrame:
    """Undirected pairs ``a < b`` with both directions and the raw total."""
    loops_out = edges.where("src <> dst")
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    return loops_out.groupBy(a.alias("a"), b.alias("b")).agg(
        F.sum(F.when(F.col("src") < F.col("dst"), F.col("n")).otherwise(0)).alias("ab"),
        F.sum(F.when(F.col("src") > F.col("dst"), F.col("n")).otherwise(0)).alias("ba"),
        F.sum("n").alias("raw"),
    )


def out_totals(edges: DataFrame) -> DataFrame:
    """Replies sent per person, below-floor pairs included, self loops not."""
    return edges.where("src <> dst").groupBy(F.col("src").alias("uid")).agg(
        F.sum("n").alias("sent")
    )


def network_candidates(users: DataFrame, pairs: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """The busiest connected people, picked before the noise floor applies."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    return (
        users.select(F.col("author_id").alias("uid"), "author_name", "messages", "first_pos")
        .join(ends, "uid", "left_semi")
        .orderBy(F.desc("messages"), "first_pos")
        .limit(max_nodes)
    )


def network_edges(
    users: DataFrame,
    edges: DataFrame,
    max_nodes: int = MAX_NODES,
    min_replies: int = MIN_PAIR_REPLIES,
) -> DataFrame:
    """Pairs among the shown people with their reciprocal affinity.

    ``weight`` is the geometric mean of the two shares of sent replies; ``w``
    is the weight relative to the strongest pair, or the raw share when every
    weight is zero.  At most ``max_nodes``² / 2 pairs are left at that point.
    """
    pairs = reply_pairs(edges)
    shown = network_candidates(users, pairs, max_nodes).select("uid")
    sent = out_totals(edges)
    kept = (
        pairs.where(F.col("raw") >= min_replies)
        .join(shown.withColumnRenamed("uid", "a"), "a", "left_semi")
        .join(shown.withColumnRenamed("uid", "b"), "b", "left_semi")
    )
    sent_a = sent.select(F.col("uid").alias("a"), F.col("sent").alias("sent_a"))
    sent_b = sent.select(F.col("uid").alias("b"), F.col("sent").alias("sent_b"))
    kept = kept.join(sent_a, "a", "left").join(sent_b, "b", "left")
    share_a = F.col("ab") / F.coalesce("sent_a", F.lit(1))
    share_b = F.col("ba") / F.coalesce("sent_b", F.lit(1))
    kept = kept.withColumn("weight", F.sqrt(share_a * share_b))
    everything = W.partitionBy()
    top_weight = F.max("weight").over(everything)
    w = F.when(top_weight > 0, F.col("weight") / top_weight).otherwise(
        F.col("raw") / F.max("raw").over(everything)
    )
    return kept.select("a", "b", "ab", "ba", "raw", "weight", w.alias("w"))


def network_nodes(users: DataFrame, edges: DataFrame, **limits) -> DataFrame:
    """Shown people that kept at least one pair, with their global rank."""
    shown_edges = network_edges(users, edges, **limits)
    ends = shown_edges.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    shown = network_candidates(users, reply_pairs(edges), limits.get("max_nodes", MAX_NODES))
    return with_rank(shown.join(ends, "uid", "left_semi"), users).drop("first_pos")


def with_rank(shown: DataFrame, users: DataFrame) -> DataFrame:
    """Adds ``rank``: how many of all people come before one of the shown.

    The shown are a few dozen at most and travel as one row to all people, who
    are counted where they lie instead of being sorted in one task.
    """
    one = F.lit(1).alias("__one")
    board = shown.groupBy(one).agg(F.collect_list(F.struct("uid", "messages", "first_pos")).alias("board"))
    before = F.filter("board", lambda b: (F.col("messages") > b["messages"]) | (
        (F.col("messages") == b["messages"]) & (F.col("first_pos") < b["first_pos"])
    ))
    ahead = users.select("messages", "first_pos", one).join(F.broadcast(board), "__one").select(F.explode(before).alias("b"))
    counts = ahead.groupBy(F.col("b.uid").alias("uid")).agg(F.count("*").alias("rank"))
    return shown.join(counts, "uid", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def reply_partners(edges: DataFrame, k: int = PARTNERS) -> DataFrame:
    """Per person: the ``k`` people most replied to and most replied by.

    The rank is cut to ``k`` before the shuffle (window group limit), so a
    person replied to by everyone does not fill one task.
    """
    loops_out = edges.where("src <> dst")
    to = loops_out.select(
        F.col("src").alias("uid"), F.lit("replies_to").alias("side"),
        F.col("dst").alias("partner"), "n", "first_pos",
    )
    by = loops_out.select(
        F.col("dst").alias("uid"), F.lit("replied_by").alias("side"),
        F.col("src").alias("partner"), "n", "first_pos",
    )
    w = W.partitionBy("uid", "side").orderBy(F.desc("n"), "first_pos")
    ranked = to.unionByName(by).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).drop("first_pos")


def top_duo(edges: DataFrame) -> DataFrame:
    """Heaviest directed edge between two people; ties by first reply."""
    return (
        edges.where("src <> dst").orderBy(F.desc("n"), "first_pos").limit(1).select("src", "dst", "n")
    )
