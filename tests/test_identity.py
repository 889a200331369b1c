import random

from pyspark.sql import functions as F

from threadlens.operators import identity as I


def labels(who):
    return {r["uid"]: r["label"] for r in who.people.collect()}


def uid(who, kind, key):
    r = who.aliases.where((F.col("kind") == kind) & (F.col("key") == key)).first()
    return r and r["uid"]


def person(key, name, username=None, ts="2025-01-01T00:00:00Z", **kw):
    return dict(author_key=key, author_name=name, author_username=username, ts=ts, **kw)


def test_same_name_different_people(make_raw):
    raw = make_raw(person("1", "kot", "alpha"), person("1", "kot", "alpha"), person("2", "kot", "zzzzz"))
    who = I.build_identity(raw)
    assert uid(who, "id", "1") != uid(who, "id", "2")
    assert sorted(labels(who).values()) == ["kot", "kot (2)"]
    assert labels(who)[uid(who, "id", "1")] == "kot"


def test_txt_author_by_username_and_handle(make_raw):
    raw = make_raw(person("1", "Nick", "handle#0001"), person(None, "handle", file_idx=1), person(None, "stranger", file_idx=1))
    who = I.build_identity(raw)
    assert uid(who, "name", "handle") == uid(who, "name", "handle#0001") == uid(who, "id", "1") == "U1"
    assert uid(who, "name", "stranger") == "U2"


def test_remade_account_is_merged_and_kept_apart_when_active_together(make_raw):
    def build(second_start):
        return I.build_identity(make_raw(
            person("1", "Cheezy", "cheezy_mc0w0", "2025-01-01T00:00:00Z"),
            person("1", "Cheezy", "cheezy_mc0w0", "2025-02-01T00:00:00Z"),
            person("1", "Cheezy", "cheezy_mc0w0", "2025-03-01T00:00:00Z"),
            person("2", "cheezy", "cheezy_mc0_0", second_start),
            person("2", "cheezy", "cheezy_mc0_0", "2025-06-01T00:00:00Z"),
        ))

    merged = build("2025-02-26T00:00:00Z")
    assert uid(merged, "id", "1") == uid(merged, "id", "2") == "U1"
    assert labels(merged) == {"U1": "cheezy"}
    apart = build("2025-01-15T00:00:00Z")
    assert uid(apart, "id", "1") != uid(apart, "id", "2")


def test_placeholders_never_merge_and_never_label(make_raw):
    raw = make_raw(
        person("1", "Deleted User", "deleted_user_a"), person("2", "Deleted User", "deleted_user_b", "2026-01-01T00:00:00Z"),
        person("3", "Real", "r"), person("3", "Deleted User", "r", "2026-01-01T00:00:00Z"),
    )
    who = I.build_identity(raw)
    assert uid(who, "id", "1") != uid(who, "id", "2")
    assert labels(who)[uid(who, "id", "3")] == "Real"


def test_freshest_export_names_the_person(make_raw, spark):
    raw = make_raw(
        person("1", "new nick", "u", "2024-01-01T00:00:00Z", file_idx=0),
        person("1", "old nick", "u", "2025-01-01T00:00:00Z", file_idx=1),
    )
    files = spark.createDataFrame([(0, "2026-01-01"), (1, "2025-02-01")], "file_idx int, d string").select(
        "file_idx", F.to_timestamp("d").alias("exported_at"))
    assert labels(I.build_identity(raw, files)) == {"U1": "new nick"}
    assert labels(I.build_identity(raw)) == {"U1": "old nick"}


def test_reply_only_people_have_labels(make_raw):
    raw = make_raw(
        person("1", "ann", reply_to_name="ghost", reply_snippet="s"),
        person("1", "ann", reply_to_key="9", reply_to_name="keyed", reply_snippet="s"),
    )
    who = I.build_identity(raw)
    assert labels(who) == {"U1": "ann", "U2": "ghost", "U3": "keyed"}
    m = I.assemble(raw, who).orderBy("msg_idx").collect()
    assert [r["parts"][0] for r in m] == ["> U2: s", "> U3: s"]
    named = I.build_identity(raw, use_real_names=True)
    m = I.assemble(raw, named).orderBy("msg_idx").collect()
    assert [r["parts"][0] for r in m] == ["> ghost: s", "> keyed: s"] and m[0]["author_id"] == "ann"


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), set()).add(i)
    return sorted(tuple(sorted(g)) for g in groups.values() if len(g) > 1)


def test_few_edges_give_the_components_of_all_pairs(spark):
    rnd = random.Random(3)
    day = 86400000
    people = []
    for i in range(160):
        stem = rnd.choice(["cheezy", "cheesy_x", "ab", "abc", "zed99", "quix"])
        name = stem + rnd.choice(["", "1", "22", "_", "x9"])
        lo = rnd.randrange(0, 400) * day
        people.append((f"u{i:03d}", rnd.choice(["n", "N", "m"]), name, lo, lo + rnd.choice([0, 3, 20, 90, 200]) * day, True))
    df = spark.createDataFrame(people, "uid string, nick string, username string, lo long, hi long, id_backed boolean")
    want = []
    for a in range(len(people)):
        for b in range(a + 1, len(people)):
            x, y = people[a], people[b]
            sim = 1 - lev(x[2].lower(), y[2].lower()) / max(len(x[2]), len(y[2])) >= 0.6
            if x[1].lower() == y[1].lower() and sim and min(x[4], y[4]) - max(x[3], y[3]) <= I.OVERLAP_TOLERANCE_MS:
                want.append((a, b))
    edges = I.remade_edges(df)
    got = [(int(r["a"][1:]), int(r["b"][1:])) for r in edges.collect()]
    assert set(got) <= set(want) and len(got) < len(want)
    assert components(len(people), got) == components(len(people), want)
    cc = I.connected_components(edges).collect()
    groups = {}
    for r in cc:
        groups.setdefault(r["root"], set()).add(int(r["uid"][1:]))
    assert sorted(tuple(sorted(g)) for g in groups.values()) == components(len(people), want)


def test_long_chain_settles(spark):
    n = 70
    edges = spark.createDataFrame([(f"v{i:03d}", f"v{i + 1:03d}") for i in range(n)], "a string, b string")
    cc = I.connected_components(edges)
    assert cc.count() == n + 1 and cc.select("root").distinct().count() == 1
