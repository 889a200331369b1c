"""Who is who: one identity model over all files.

Messages are first folded into author observations (one row per distinct
author triple and file), so everything after the first aggregation is
identity-sized.  It stays distributed all the same: numbering and label
disambiguation use the sliced operations of ``ordered``, pair candidates come
from an exact prefix filter and not from all pairs of a nickname.

Positions (``at``) are structs ``(file_idx, msg_idx)``; passes are numbered as
in the registration order: 1 id-backed authors, 2 username aliases, 3 authors
without id, 4 people only seen in replies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import js_trim, non_empty
from ..functions.clock import millis
from ..functions.names import SIMILAR_AT, is_placeholder, username_similar
from ..functions.parts import assemble_parts
from ..session import materialize
from .ordered import MAX_GROUP_ROWS, row_numbers, slice_groups
from .skew import HOT_ROWS, join_dimension

OVERLAP_TOLERANCE_MS = 7 * 24 * 60 * 60 * 1000  # fixed value: a week of transition


@dataclass(frozen=True)
class Identity:
    """``people(uid, label)`` and ``aliases(kind, key, uid)``, kind id or name."""

    people: DataFrame
    aliases: DataFrame


def _at() -> Column:
    return F.struct("file_idx", "msg_idx")


def file_recency(raw: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Export time per file in ms, else its newest message, else 0."""
    newest = raw.groupBy("file_idx").agg(F.max(millis(F.col("ts"))).alias("newest"))
    if files is None:
        return newest.select("file_idx", F.coalesce("newest", F.lit(0)).alias("recency"))
    stated = files.select("file_idx", millis(F.col("exported_at")).alias("stated"))
    return newest.join(stated, "file_idx", "left").select(
        "file_idx", F.coalesce("stated", "newest", F.lit(0)).alias("recency")
    )


def observations(raw: DataFrame) -> DataFrame:
    """Author triples per file with count, span and position."""
    t = F.coalesce(millis(F.col("ts")), F.lit(0))
    return raw.groupBy(
        "file_idx",
        non_empty(F.col("author_key")).alias("key"),
        F.coalesce("author_name", F.lit("")).alias("raw_name"),
        js_trim(F.coalesce("author_name", F.lit(""))).alias("name"),
        js_trim(F.coalesce("author_username", F.lit(""))).alias("username"),
    ).agg(
        F.count("*").alias("n"),
        F.min(t).alias("lo"),
        F.max(t).alias("hi"),
        F.min(_at()).alias("at"),
        # last row of the newest instant: where a name was seen most recently
        F.max(F.struct(t.alias("t"), _at().alias("at"))).alias("latest"),
    )


def reply_mentions(raw: DataFrame) -> DataFrame:
    """People named by replies, by key where known, else by name."""
    named = raw.where("reply_to_name IS NOT NULL AND reply_to_name <> '' OR reply_to_key IS NOT NULL")
    return named.groupBy(
        non_empty(F.col("reply_to_key")).alias("key"),
        js_trim(F.coalesce("reply_to_name", F.lit(""))).alias("name"),
    ).agg(F.min(_at()).alias("at"))


def register(obs: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All identities in registration order and the names they claimed.

    Returns ``minted(kind, key, pass, at)`` and ``claims(name, owner_kind,
    owner_key, pass, at, sub)`` with one row per name.  A name belongs to the
    first offer over passes and then over document order, so two aggregations
    settle everything: one over keys, one over names.
    """
    offers = obs.where(F.col("key").isNotNull()).select("key", "name", F.lit(1).alias("pass"), "at")
    offers = offers.unionByName(
        mentions.where(F.col("key").isNotNull()).select("key", "name", F.lit(4).alias("pass"), "at")
    )
    # a known key offers no further names: only its first one counts
    keys = offers.groupBy("key").agg(F.min(F.struct("pass", "at", "name")).alias("f"))
    keys = keys.select("key", "f.*")

    def offer(df: DataFrame, kind: str, owner: str, no, sub=None) -> DataFrame:
        return df.select(
            "name",
            F.struct(
                (F.lit(no) if isinstance(no, int) else no).alias("pass"),
                F.col("at"),
                (F.lit(0) if sub is None else sub).alias("sub"),
                F.lit(kind).alias("owner_kind"),
                F.col(owner).alias("owner_key"),
            ).alias("o"),
        ).where("name <> ''")

    handles = F.array(F.col("username"), js_trim(F.substring_index("username", "#", 1)))
    aliases = obs.where(F.col("key").isNotNull() & (F.col("username") != "")).select(
        "key", "at", F.posexplode(handles).alias("sub", "name")
    )
    loose = obs.where(F.col("key").isNull())
    replies = mentions.where(F.col("key").isNull())
    named = (
        offer(keys, "id", "key", F.col("pass"))
        .unionByName(offer(aliases, "id", "key", 2, F.col("sub")))
        .unionByName(offer(loose, "name", "name", 3))
        .unionByName(offer(replies, "name", "name", 4))
    )
    claims = named.groupBy("name").agg(F.min("o").alias("o")).select("name", "o.*")
    minted = keys.select(F.lit("id").alias("kind"), "key", "pass", "at").unionByName(
        claims.where("owner_kind = 'name'").select(
            F.lit("name").alias("kind"), F.col("name").alias("key"), "pass", "at"
        )
    )
    return minted, claims


def number_identities(minted: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """``U1``, ``U2``, … in registration order."""
    o = slice_groups(minted, [], ["pass", "at", "kind", "key"], max_rows)
    out = row_numbers(o, "no").result()
    return out.withColumn("uid", F.concat(F.lit("U"), F.col("no").cast("string")))


def alias_table(numbered: DataFrame, claims: DataFrame) -> DataFrame:
    """``kind, key, uid, pass, at, sub``: what a key or a name resolves to."""
    by_id = numbered.where("kind = 'id'").select(
        "kind", "key", "uid", "pass", "at", F.lit(0).alias("sub")
    )
    owner = numbered.select(F.col("kind").alias("owner_kind"), F.col("key").alias("owner_key"), "uid")
    by_name = claims.join(owner, ["owner_kind", "owner_key"]).select(
        F.lit("name").alias("kind"), F.col("name").alias("key"), "uid", "pass", "at", "sub"
    )
    return by_id.unionByName(by_name)


def resolve(
    df: DataFrame, aliases: DataFrame, key: str, name: str, out: str, spread=None, hot_rows=HOT_ROWS
) -> DataFrame:
    """Add the uid of (key, name): by key if there is one, else by name."""
    lookup = aliases.select(F.col("kind").alias("__kind"), F.col("key").alias("__key"), F.col("uid").alias(out))
    keyed = non_empty(F.col(key)).isNotNull()
    df = df.withColumn("__kind", F.when(keyed, F.lit("id")).otherwise(F.lit("name")))
    df = df.withColumn("__key", F.when(keyed, F.col(key)).otherwise(F.col(name)))
    if spread:
        joined = join_dimension(df, lookup, ["__kind", "__key"], spread, hot_rows=hot_rows)
    else:
        joined = df.join(lookup, ["__kind", "__key"], "left")
    return joined.drop("__kind", "__key")


def _slots(prefix: str = "") -> list[Column]:
    """Best name per slot: freshest export, then newest time, then latest row."""
    rank = F.struct("recency", F.col("latest.t").alias("t"), F.col("latest.at").alias("at"))
    real = (F.col("name") != "") & ~is_placeholder(F.col("name"))
    keyed = F.col("key").isNotNull()

    def best(cond: Column) -> Column:
        return F.max(F.when(cond, F.struct(rank.alias("rank"), F.col("name").alias("name"))))

    return [
        best(real & keyed).alias("real_id"),
        best(real & ~keyed).alias("real_no_id"),
        best(F.col("name") != "").alias("any_name"),
    ]


def profile(obs: DataFrame, aliases: DataFrame, recency: DataFrame) -> DataFrame:
    """Per uid: count, activity span, first username and the three name slots."""
    seen = resolve(obs, aliases, "key", "name", "uid").where(F.col("uid").isNotNull())
    seen = seen.join(recency, "file_idx", "left").withColumn(
        "recency", F.coalesce("recency", F.lit(0))
    )
    handle = F.when(F.col("key").isNotNull() & (F.col("username") != ""), F.col("at"))
    out = seen.groupBy("uid").agg(
        F.sum("n").alias("n"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.min("at").alias("at"),
        F.bool_or(F.col("key").isNotNull()).alias("id_backed"),
        F.min_by("username", handle).alias("username"),
        *_slots(),
    )
    return out.withColumn("nick", _nick())


def _nick() -> Column:
    return F.coalesce("real_id.name", "real_no_id.name", "any_name.name", "uid")


# ── remade accounts ─────────────────────────────────────────────────────────


def _prefix_tokens(username: Column) -> Column:
    """Numbered characters of a username, cut to its prefix-filter length.

    Two names at similarity 0.6 share at least ``ceil(0.6·len)`` numbered
    characters, so under any fixed order their first ``len - ceil(0.6·len) + 1``
    characters have one in common.  No true pair is lost.
    """
    low = F.lower(username)
    chars = F.filter(F.split(low, ""), lambda c: c != "")

    def numbered(c: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda d: d == c))
        return F.concat(c, before.cast("string"))

    tokens = F.array_sort(F.transform(chars, numbered))
    n = F.size(chars)
    keep = n - F.ceil(n * F.lit(SIMILAR_AT) - F.lit(1e-9)).cast("int") + 1
    return F.slice(F.reverse(tokens), F.lit(1), F.greatest(keep, F.lit(1)))


def similar_usernames(names: DataFrame, group: str = "nick", name: str = "username") -> DataFrame:
    """Pairs ``a < b`` of distinct similar usernames inside a group.

    Candidates share a prefix token and fit in length; a pair is emitted for
    the first token it shares only, so it is compared once.
    """
    uniq = names.select(group, F.lower(name).alias("u")).where("u <> ''").distinct()
    tok = uniq.select(group, "u", _prefix_tokens(F.col("u")).alias("toks"))
    flat = tok.select(group, "u", "toks", F.explode("toks").alias("tok"))
    a = flat.select(group, "tok", F.col("u").alias("a"), F.col("toks").alias("ta"))
    b = flat.select(group, "tok", F.col("u").alias("b"), F.col("toks").alias("tb"))
    first_shared = F.get(F.array_intersect("ta", "tb"), F.lit(0)) == F.col("tok")
    near = F.abs(F.length("a") - F.length("b")) <= F.greatest(F.length("a"), F.length("b")) * 0.4 + 1e-9
    pairs = a.join(b, [group, "tok"]).where((F.col("a") < F.col("b")) & near & first_shared)
    return pairs.where(username_similar(F.col("a"), F.col("b"))).select(group, "a", "b")


def remade_edges(people: DataFrame) -> DataFrame:
    """Edges whose components are the groups of remade accounts.

    Two accounts belong together when nickname and username match closely and
    their activity overlaps by a week at most.  Among accounts with mutually
    similar usernames every such pair is already connected through three of
    them: the one that ends first, the one that starts last and the shortest.
    Only edges to these three are drawn, never all pairs of a group.

    ``people`` needs ``uid, nick, username, lo, hi, id_backed``.
    """
    base = people.where(
        F.col("id_backed") & ~is_placeholder(F.col("nick")) & (F.col("username") != "")
    ).select("uid", F.lower("nick").alias("nick"), F.lower("username").alias("u"), "lo", "hi")
    anchor = F.struct("uid", "lo", "hi")
    hubs = base.groupBy("nick", "u").agg(
        F.min_by(anchor, F.struct("hi", "uid")).alias("h1"),
        F.max_by(anchor, F.struct("lo", "uid")).alias("h2"),
        F.min_by(anchor, F.struct(F.col("hi") - F.col("lo"), F.col("uid"))).alias("h3"),
    )
    hubs = hubs.select("nick", "u", F.explode(F.array_distinct(F.array("h1", "h2", "h3"))).alias("hub"))
    pairs = similar_usernames(base.withColumnRenamed("u", "username"))
    linked = pairs.select("nick", F.col("a").alias("u"), F.col("b").alias("other")).unionByName(
        pairs.select("nick", F.col("b").alias("u"), F.col("a").alias("other"))
    )
    same = hubs.select("nick", "u", "hub")
    across = linked.join(hubs.withColumnRenamed("u", "other"), ["nick", "other"]).select("nick", "u", "hub")
    reach = base.join(same.unionByName(across), ["nick", "u"])
    overlap = F.least("hi", "hub.hi") - F.greatest("lo", "hub.lo")
    near = reach.where((F.col("uid") != F.col("hub.uid")) & (overlap <= OVERLAP_TOLERANCE_MS))
    return near.select(
        F.least("uid", "hub.uid").alias("a"), F.greatest("uid", "hub.uid").alias("b")
    ).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``uid, root`` for every end of an edge; root is the smallest uid.

    Labels spread to neighbours and then jump to the label of their label, so
    the number of rounds grows with the logarithm of the diameter.  Each round
    is written out, which keeps the plan short and survives lost executors.
    """
    both = materialize(
        edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
        .distinct(),
        "cc-edges",
    )
    labels = both.groupBy(F.col("src").alias("uid")).agg(F.min("dst").alias("m")).select(
        "uid", F.least("uid", "m").alias("root")
    )
    if labels.isEmpty():
        return labels
    labels = materialize(labels, "cc")
    while True:
        near = (
            both.join(labels.select(F.col("uid").alias("dst"), "root"), "dst")
            .groupBy(F.col("src").alias("uid"))
            .agg(F.min("root").alias("near"))
        )
        spread = labels.join(near, "uid").select(
            "uid", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        jump = spread.select(F.col("uid").alias("root"), F.col("root").alias("far"))
        step = spread.join(jump, "root", "left").select(
            "uid", "old", F.least("root", F.coalesce("far", "root")).alias("root")
        )
        step = materialize(step, "cc")
        changed = not step.where("root <> old").isEmpty()
        labels = step.select("uid", "root")
        if not changed:
            return labels


def fold_remade(people: DataFrame, components: DataFrame) -> DataFrame:
    """Add ``canon``: the busiest member of the component, earliest on ties."""
    rooted = people.join(components, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    pick = rooted.groupBy("root").agg(
        F.max_by(
            "uid", F.struct(F.col("n"), (-F.col("at.file_idx")).alias("f"), (-F.col("at.msg_idx")).alias("m"))
        ).alias("canon")
    )
    return rooted.join(pick, "root").drop("root")


def label_people(members: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """``uid, label, n``: one distinct label per canonical identity.

    Name slots are taken over all members again; equal labels get a number,
    the busiest identity keeping the plain one.
    """
    slots = ("real_id", "real_no_id", "any_name")
    # ties between members go to the later one
    ranked = [
        F.max(F.when(F.col(s).isNotNull(), F.struct(
            F.col(f"{s}.rank.recency").alias("recency"), F.col(f"{s}.rank.t").alias("t"),
            F.col("at").alias("at"), F.col(f"{s}.name").alias("name")))).alias(s)
        for s in slots
    ]
    folded = members.groupBy(F.col("canon").alias("uid")).agg(
        F.sum("n").alias("n"), F.min("at").alias("at"), *ranked
    )
    folded = folded.withColumn("label", _nick())
    folded = folded.select(
        "uid", "n", "label", (-F.col("n")).alias("busy"), "at"
    )
    o = row_numbers(slice_groups(folded, ["label"], ["busy", "at", "uid"], max_rows), "nth")
    numbered = F.concat("label", F.lit(" ("), F.col("nth").cast("string"), F.lit(")"))
    return o.result().select(
        "uid", F.when(F.col("nth") > 1, numbered).otherwise(F.col("label")).alias("label"), "n"
    )


def build_identity(
    raw: DataFrame,
    files: DataFrame | None = None,
    use_real_names: bool = False,
    max_rows: int = MAX_GROUP_ROWS,
) -> Identity:
    """Identity model over all raw messages of all files."""
    obs = materialize(observations(raw), "observations")
    minted, claims = register(obs, reply_mentions(raw))
    minted, claims = materialize(minted, "minted"), materialize(claims, "claims")
    numbered = number_identities(minted, max_rows)
    aliases = materialize(alias_table(numbered, claims), "aliases")
    people = materialize(profile(obs, aliases, file_recency(raw, files)), "people")
    components = connected_components(remade_edges(people))
    members = materialize(fold_remade(people, components), "members")
    labels = label_people(members, max_rows)

    canon = members.select("uid", "canon")
    aliases = aliases.join(canon, "uid", "left").select(
        "kind", "key", F.coalesce("canon", "uid").alias("uid"), "pass", "at", "sub"
    )
    # people without any message: their first name, else the uid itself
    first_name = (
        aliases.where("kind = 'name'")
        .groupBy("uid")
        .agg(F.min_by("key", F.struct("pass", "at", "sub")).alias("name"))
    )
    silent = (
        aliases.select("uid").distinct()
        .join(labels.select("uid"), "uid", "left_anti")
        .join(first_name, "uid", "left")
        .select("uid", F.coalesce("name", "uid").alias("label"), F.lit(0).cast("bigint").alias("n"))
    )
    people_out = labels.unionByName(silent)
    aliases = aliases.select("kind", "key", "uid")
    if use_real_names:
        to_label = people_out.select("uid", "label")
        aliases = aliases.join(to_label, "uid", "left").select(
            "kind", "key", F.coalesce("label", "uid").alias("uid")
        )
        people_out = people_out.groupBy("label").agg(F.sum("n").alias("n"))
        people_out = people_out.select(F.col("label").alias("uid"), "label", "n")
    return Identity(materialize(people_out, "labels"), materialize(aliases, "aliases"))


def assemble(raw: DataFrame, identity: Identity, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Raw messages with ids, reply token and reactions in place."""
    pos = ["file_idx", "msg_idx"]
    df = raw.withColumn("__name", F.coalesce("author_name", F.lit("")))
    df = resolve(df, identity.aliases, "author_key", "__name", "__uid", pos, hot_rows)
    df = df.withColumn("author_id", F.coalesce("__uid", "__name")).drop("__uid", "__name")
    df = resolve(df, identity.aliases, "reply_to_key", "reply_to_name", "__to", pos, hot_rows)
    has_reply = F.col("reply_to_name").isNotNull()
    parts = assemble_parts(
        F.coalesce("__to", "reply_to_name"), has_reply, F.col("reply_snippet"),
        F.col("parts"), F.col("reactions"),
    )
    return df.withColumn("parts", parts).withColumn("has_reply", has_reply).select(
        "channel_id", "file_idx", "grp_file_idx", "msg_idx", "format", "message_id",
        "author_id", "author_name", "ts", "parts", "is_system", "has_reply",
        non_empty(F.col("reply_to_message_id")).alias("reply_to_message_id"),
    )
