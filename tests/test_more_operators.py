from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kvarn.operators import antientropy, coordination, limits, membership, ring, sketches, versioning


def test_owners_of_a_map_with_gaps(spark):
    ranges = spark.createDataFrame([("b", "m", ["n1"]), ("p", "t", ["n2"])], "start string, end string, replicas array<string>")
    keys = spark.createDataFrame([(k,) for k in ["a", "b", "c", "m", "n", "p", "sz", "t", "z", None]], "key string")
    got = {r["key"]: r["range_start"] for r in ring.owners(keys, ranges).collect()}
    assert got == {"b": "b", "c": "b", "p": "p", "sz": "p"}


def test_owners_of_many_ranges(spark):
    cuts = ["", *(f"{i:04d}" for i in range(1, 600)), ""]
    ranges = spark.createDataFrame([(a, b, ["n"]) for a, b in zip(cuts, cuts[1:])], "start string, end string, replicas array<string>")
    keys = spark.createDataFrame([(f"{i:04d}x",) for i in range(0, 700, 7)], "key string")
    got = {r["key"]: r["range_start"] for r in ring.owners(keys, ranges).collect()}
    assert got == {f"{i:04d}x": "" if i == 0 else f"{min(i, 599):04d}" for i in range(0, 700, 7)}


def test_sync_samples_a_peer_when_none_is_ahead():
    a = [ring.Range("", "", ("n1",), 2, "p")]
    b = [ring.Range("", "m", ("n2",), 2, "a"), ring.Range("m", "", ("n2",), 2, "a")]
    table = ring.RangeTable(a)
    assert table.sync({"x": (2, b)}, seed=1) and table.epoch() == 3
    assert not ring.RangeTable(a).sync({}, seed=1) and not ring.RangeTable(a).sync({"x": (2, a)})


def plain_leaves(left, right, start, end, fanout, leaf_rows, depth):
    inside = lambda rows: {k: v for k, v in rows.items() if k.encode() >= start and (not end or k.encode() < end)}
    a, b = inside(left), inside(right)
    if a == b:
        return []
    parts = antientropy.split_range(start, end, fanout)
    if not depth or max(len(a), len(b)) <= leaf_rows or len(parts) == 1:
        return [(start, end)]
    return [x for s, e in parts for x in plain_leaves(left, right, s, e, fanout, leaf_rows, depth - 1)]


def test_differing_leaves_against_plain(spark):
    rng = random.Random(2)
    left = {"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))): str(i) for i in range(3000)}
    right = dict(left)
    for k in rng.sample(sorted(left), 12):
        right[k] = "other"
    for k in rng.sample(sorted(left), 3):
        right.pop(k, None)
    frames = [spark.createDataFrame(list(x.items()), "key string, value string") for x in (left, right)]
    for start, end in ((b"", b""), (b"a", b"i"), (b"c", b"")):
        got = antientropy.differing_leaves(*frames, start, end, 4, 32, 6)
        assert got == sorted(plain_leaves(left, right, start, end, 4, 32, 6))
    assert antientropy.differing_leaves(frames[0], frames[0]) == []


def replica(spark, rows):
    clock = F.map_from_arrays(F.array(F.lit("w")), F.array(F.col("c").cast("decimal(20,0)")))
    return spark.createDataFrame(rows, "key string, value string, c long").withColumn("vector_clock", clock).drop("c")


def test_repair_looks_ownership_up_again(spark):
    ranges = spark.createDataFrame([("", "m", ["a", "b"]), ("m", "", ["b"])], "start string, end string, replicas array<string>")
    here, there = replica(spark, [("c", "old", 1)]), replica(spark, [("c", "new", 2), ("x", "not ours", 1)])
    mine, theirs = antientropy.repair(here, there, ranges=ranges, local_id="a", peer_id="b")
    assert {r["key"]: r["value"] for r in mine.collect()} == {"c": "new"} and theirs.count() == 2
    with pytest.raises(antientropy.NotOwner):
        antientropy.repair(replica(spark, [("c", "v", 1), ("x", "v", 1)]), here.limit(0), ranges=ranges, local_id="b", peer_id="a")


def test_a_round_with_a_seeded_peer(spark):
    assert antientropy.pick_peer(["a"], "a", 1) is None
    picks = {antientropy.pick_peer(["c", "a", "b"], "a", s) for s in range(20)}
    assert picks == {"b", "c"} and antientropy.pick_peer(["a", "b", "c"], "a", 3) == antientropy.pick_peer(["c", "b", "a"], "a", 3)
    ranges = spark.createDataFrame([("", "m", ["a", "b"]), ("m", "", ["a", "c"])], "start string, end string, replicas array<string>")
    nodes = {"a": replica(spark, [("c", "1", 1), ("x", "1", 1)]), "b": replica(spark, [("d", "2", 1)]), "c": replica(spark, [("x", "3", 2)])}
    after = antientropy.repair_round(nodes, ranges, "a", 5)
    state = {n: {r["key"]: r["value"] for r in d.collect()} for n, d in after.items()}
    assert state == {"a": {"c": "1", "d": "2", "x": "3"}, "b": {"c": "1", "d": "2"}, "c": {"x": "3"}}


def test_sketches_are_saved_and_loaded(spark, tmp_path):
    e = spark.createDataFrame([(f"e{i}",) for i in range(500)], "e string")
    m, k = sketches.bloom_size(500, 0.01)
    w, d = sketches.cms_size(0.05, 0.05)
    made = {
        "bloom": (sketches.bloom(e, "e", m, k), {"m": m, "k": k}),
        "cms": (sketches.cms(e, "e", w, d), {"w": w, "d": d}),
        "hll": (sketches.hll(e, "e", 10), {"p": 10}),
        "simhash": (sketches.simhash(e.selectExpr("e as id", "e as t"), "id", "t"), {"bits": 64}),
        "merkle": (sketches.merkle_leaves(e.selectExpr("'t' as tree", "e as key", "e as value"), "tree"), {"leaves": 500}),
    }
    for name, (sketch, about) in made.items():
        sketches.save(sketch, str(tmp_path / name), kind=name, **about)
        back, saved = sketches.load(spark, str(tmp_path / name), kind=name)
        assert saved == {"kind": name} | about and sorted(map(tuple, back.collect())) == sorted(map(tuple, sketch.collect()))
    bits, _ = sketches.load(spark, str(tmp_path / "bloom"), m=m, k=k)
    assert sketches.bloom_contains(bits, e, "e", m, k).filter("not maybe").count() == 0
    with pytest.raises(ValueError):
        sketches.load(spark, str(tmp_path / "hll"), p=12)


def test_trees_of_more_leaves_than_said(spark):
    rows = spark.createDataFrame([("a", f"k{i:03d}", "v") for i in range(37)] + [("b", "k", "v")], "tree string, key string, value string")
    leaves = sketches.merkle_leaves(rows, "tree", chunk_chars=3)
    assert [r["idx"] for r in leaves.filter("tree = 'a'").join(rows, "tree").select("idx").distinct().orderBy("idx").collect()] == list(range(37))
    roots = sketches.merkle_root(leaves, "tree", 4).collect()
    assert len(roots) == 2 and {r["root"] for r in roots} == {r["root"] for r in sketches.merkle_root(leaves, "tree", 64).collect()}


def test_near_fingerprints_against_all_pairs(spark):
    rng = random.Random(1)
    prints = [format(rng.getrandbits(64), "064b") for _ in range(60)]
    for p in list(prints):
        bits = list(p)
        for i in rng.sample(range(64), rng.randrange(0, 6)):
            bits[i] = "10"[int(bits[i])]
        prints.append("".join(bits))
    df = spark.createDataFrame(list(enumerate(prints)), "id long, fingerprint string")
    reps = {r["id"]: r["representative"] for r in sketches.fingerprint_groups(df, "id").collect()}
    assert reps == {i: prints.index(p) for i, p in enumerate(prints)}
    apart = lambda a, b: sum(x != y for x, y in zip(prints[a], prints[b]))
    ids = sorted(set(reps.values()))
    want = {(a, b, apart(a, b)) for a in ids for b in ids if a < b and apart(a, b) <= 3}
    assert {tuple(r) for r in sketches.near_fingerprints(df, "id", 3).collect()} == want and want


def test_a_hot_user_is_folded_in_order(spark):
    rows = [(1, i, i // 50) for i in range(30_000)] + [(2, 0, 0)]
    random.Random(0).shuffle(rows)
    got = limits.token_bucket(spark.createDataFrame(rows, "user long, seq long, ts_seconds long"), 2.0, 10).collect()
    tokens, last, want = 10, None, {}
    for i in range(30_000):
        want[i], tokens, last = limits.take(tokens, i // 50 if last is None else last, i // 50, 2.0, 10)
    assert {r["seq"]: r["allowed"] for r in got if r["user"] == 1} == want


def test_membership_upsert_and_stamp(spark):
    cols = "node_id string, status string, incarnation long, membership_epoch long"
    members = spark.createDataFrame([("a", "alive", 5, 3), ("b", "dead", 9, 3)], cols)
    after = membership.upsert(members, spark.createDataFrame([("b", "alive", 1, 0), ("c", "suspect", 2, 0)], cols))
    assert sorted(map(tuple, after.collect())) == [("a", "alive", 5, 3), ("b", "alive", 1, 0), ("c", "suspect", 2, 0)]
    stamped = membership.stamped(after, 2, spark.createDataFrame([("a",), ("c",)], "node_id string"))
    assert {r["node_id"]: r["membership_epoch"] for r in stamped.collect()} == {"a": 3, "b": 0, "c": 2}
    plan = membership.probe_plan(["a", "b", "c", "d"], "a", 4, helpers=5, seeds=["a", "b", "z"])
    assert plan["seeds"] == ["z"] and len(plan["direct"]) == 1 and sorted(plan["direct"] + plan["indirect"]) == ["b", "c", "d"]
    assert membership.probe_plan(["a"], "a", 1) == {"seeds": [], "direct": [], "indirect": []}


def test_stored_envelopes_agree_with_their_operation(spark):
    clock = F.create_map(F.lit("n"), F.lit(1).cast("decimal(20,0)"))
    rows = spark.createDataFrame([("a", 1, False, "v"), ("b", 2, True, None)], "key string, op int, gone boolean, v string")
    stored = coordination.stored(rows.withColumn("envelope", versioning.envelope(clock, F.lit(7), F.col("gone"), F.col("v"))))
    back = {r["key"]: r["envelope"] for r in coordination.decoded(stored).collect()}
    assert back["a"]["value"] == "v" and back["b"]["deleted"] and {r["op"] for r in stored.collect()} == {1}
    wrong = rows.withColumn("op", F.lit(1)).withColumn("envelope", versioning.envelope(clock, F.lit(7), F.col("gone"), F.col("v")))
    with pytest.raises(Exception, match="disagree"):
        coordination.stored(wrong).collect()


def test_clock_entries(spark):
    sent = spark.createDataFrame([([("b", 2), ("", 9), ("a", 1), ("b", 1)],)], "e array<struct<node:string,counter:long>>").select(versioning.from_entries(F.col("e")).alias("c"))
    assert {k: int(v) for k, v in sent.first()["c"].items()} == {"a": 1, "b": 2}
    assert [(x["node"], int(x["counter"])) for x in sent.select(versioning.to_entries(F.col("c")).alias("e")).first()["e"]] == [("a", 1), ("b", 2)]
