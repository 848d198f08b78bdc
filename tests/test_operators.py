from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kvarn import config
from kvarn.operators import antientropy, compaction, coordination, limits, membership, ring, sketches, state, tablet, versioning
from kvarn.operators.ring import Range


def clocks(spark, a, b):
    kind = "a map<string,decimal(20,0)>, b map<string,decimal(20,0)>"
    from decimal import Decimal

    fix = lambda c: {k: Decimal(v) for k, v in c.items()}
    return spark.createDataFrame([(fix(a), fix(b))], kind)


@pytest.mark.parametrize(
    ("a", "b", "relation"),
    [
        ({}, {}, "equal"),
        ({"a": 1, "b": 2}, {"a": 1, "b": 2}, "equal"),
        ({"a": 1, "b": 1}, {"a": 2, "b": 1}, "before"),
        ({"a": 3, "b": 1}, {"a": 2, "b": 1}, "after"),
        ({"a": 2, "b": 1}, {"a": 1, "b": 2}, "concurrent"),
        ({"a": 1}, {"a": 1, "b": 1}, "before"),
        ({"a": 1, "b": 0}, {"a": 1}, "equal"),
    ],
)
def test_clock_relations(spark, a, b, relation):
    df = clocks(spark, a, b)
    assert df.select(versioning.compare(F.col("a"), F.col("b"))).first()[0] == relation
    merged = df.select(versioning.merge(F.col("a"), F.col("b"))).first()[0]
    assert {k: int(v) for k, v in merged.items()} == {k: max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}}


def versions(spark, *vs):
    rows = [(list(vs),)]
    kind = "vs array<struct<vector_clock:map<string,int>,updated_at_unix_nano:bigint,deleted:boolean,value:string>>"
    return spark.createDataFrame(rows, kind)


def v(clock, deleted=False, value="", at=1):
    return (clock, at, deleted, value)


@pytest.mark.parametrize(
    ("given", "kept"),
    [
        ([v({"a": 1}, value="x"), v({"a": 2}, value="y")], ["y"]),
        ([v({"a": 1}, value="x"), v({"b": 1}, value="y")], ["x", "y"]),
        ([v({"a": 1}, value="x"), v({"a": 1}, value="x")], ["x"]),
        ([v({"a": 1}, value="x"), v({"a": 2}, True)], [""]),
        ([v({"a": 2}, True), v({"a": 3}, value="z")], ["z"]),
        ([v({"a": 1}, True), v({"b": 1}, value="y")], ["", "y"]),
        ([], []),
    ],
)
def test_reconcile(spark, given, kept):
    got = versions(spark, *given).select(versioning.reconcile(F.col("vs"))).first()[0]
    assert [x["value"] for x in got] == kept


def test_timestamp_pick(spark):
    df = versions(spark, v({"a": 1}, value="a", at=5), v({"b": 1}, value="b", at=5), v({"c": 1}, value="z", at=4))
    assert df.select(versioning.pick_by_timestamp(F.col("vs"))).first()[0]["value"] == "b"
    df = versions(spark, v({"a": 1}, value="z", at=5), v({"b": 1}, True, at=5))
    assert df.select(versioning.pick_by_timestamp(F.col("vs"))).first()[0]["deleted"]


def test_increment_and_context(spark):
    df = clocks(spark, {"a": 1}, {})
    assert {k: int(x) for k, x in df.select(versioning.increment(F.col("a"), "a")).first()[0].items()} == {"a": 2}
    assert {k: int(x) for k, x in df.select(coordination.next_clock(F.col("b"), "n")).first()[0].items()} == {"n": 1}


def test_decode_refuses(spark):
    df = spark.createDataFrame([("plain",), (versioning.MAGIC + '{"version":2,"updated_at_unix_nano":1}',), (versioning.MAGIC + '{"version":1,"updated_at_unix_nano":0}',)], "t string")
    assert [r[0] for r in df.select(versioning.decode(F.col("t"))).collect()] == [None, None, None]


def two(m, n):
    a = [Range("", m, ("n1",), 2, "a"), Range(m, "", ("n1",), 2, "a")]
    b = [Range("", n, ("n2",), 2, "b"), Range(n, "", ("n2",), 2, "b")]
    return a, b


def test_map_merge_converges():
    a, b = two("m", "n")
    left, changed = ring.merge_maps(a, b)
    right, _ = ring.merge_maps(b, a)
    assert left == right and changed
    assert [(r.end, r.generation) for r in left] == [("m", 3), ("", 3)]
    assert ring.merge_maps(left, b)[0] == left and not ring.merge_maps(left, left)[1]


def test_map_merge_generation_and_limits():
    a = [Range("", "", ("n1",), 5, "a")]
    b = [Range("", "k", ("n2",), 6, "b"), Range("k", "", ("n2",), 4, "b")]
    assert [(r.start, r.end, r.generation, r.proposal_id) for r in ring.merge_maps(a, b)[0]] == [("", "k", 6, "b"), ("k", "", 5, "a")]
    top = [Range("", "", ("n1",), ring.MAX_GENERATION, "a")], [Range("", "", ("n2",), ring.MAX_GENERATION, "b")]
    with pytest.raises(ValueError, match="highest generation"):
        ring.merge_maps(*top)
    with pytest.raises(ValueError, match="not_contiguous"):
        ring.merge_maps([Range("", "c", ("n",), 1, "p"), Range("d", "", ("n",), 1, "p")], a)


def test_proposal_id_ignores_order():
    a = [Range("", "m", ("x", "y"), 1, ""), Range("m", "", ("y", "z"), 1, "")]
    b = [Range("m", "", ("z", "y"), 9, "q"), Range("", "m", ("y", "x"), 9, "q")]
    assert ring.proposal_id(a) == ring.proposal_id(b) != ring.proposal_id(a[:1])


def test_owner_search_agrees_with_join(spark):
    cuts = ["", *[f"k{i:03d}" for i in range(1, 300)], ""]
    rows = [(a, b, [f"n{i}"], 1, "p") for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    ranges = spark.createDataFrame(rows, "start string, end string, replicas array<string>, generation long, proposal_id string")
    keys = spark.createDataFrame([(f"k{i:03d}{s}",) for i in range(0, 300, 7) for s in ("", "x")], "key string")
    many = sorted(map(tuple, ring.owners(keys, ranges).select("key", "range_start").collect()))
    joined = keys.join(F.broadcast(ranges), ring.within(F.col("key"), F.col("start"), F.col("end")))
    assert many == sorted(map(tuple, joined.select("key", "start").collect()))


def test_table_sync():
    t = ring.RangeTable([Range("", "", ("n1",), 1, "a")])
    assert t.sync({"p": (2, [Range("", "m", ("n1",), 2, "b"), Range("m", "", ("n2",), 2, "b")])})
    assert t.epoch() == 2 and t.is_owner("n2", "z") and not t.sync({"p": (2, [])})


def test_placement():
    nodes = [f"n{i}" for i in range(5)]
    for count in (1, 2, 3):
        got = tablet.assign_replicas("a", "b", nodes, ["n0", "n1", "n2"], count)
        assert len(got) == count and len(set(got) - {"n0", "n1", "n2"}) <= 1
    assert tablet.assign_replicas("a", "b", nodes, ["n4"], 1) == ["n4"]
    with pytest.raises(tablet.UnsafePlacement):
        tablet.assign_replicas("a", "b", nodes, ["gone"], 2)
    with pytest.raises(ValueError):
        tablet.assign_replicas("a", "b", nodes, [], 9)


def test_split_boundary_cases(spark):
    kv = lambda *rows: spark.createDataFrame([("t", *r) for r in rows], "tablet string, key string, value string")
    assert tablet.split_boundaries(kv(("a", "123456"), ("b", "x"), ("c", "x"), ("d", "x"))).first()["boundary"] == "b"
    assert tablet.split_boundaries(kv(("a", "1"))).count() == 0
    assert tablet.sizes(kv(("a", "123"), ("long", "xy"))).first()["bytes"] == 10


def test_tick_splits_before_merging():
    ranges = [Range("", "m", ("n1", "n2"), 1, "p"), Range("m", "", ("n1", "n2"), 1, "p")]
    new = tablet.plan_tick(ranges, {"": 900, "m": 10}, {"", "m"}, "n1", ["n1", "n2", "n3"], {"": "f"}, 500, 100, 2)
    assert [r.start for r in new] == ["", "f", "m"]
    new = tablet.plan_tick(ranges, {"": 50, "m": 10}, {"", "m"}, "n1", ["n1", "n2"], {}, 500, 100, 2)
    assert len(new) == 1 and not ring.problems(new)
    assert tablet.plan_tick(ranges, {"": 50, "m": 10}, set(), "n1", ["n1"], {}, 500, 100, 2) is None


def test_split_range():
    assert antientropy.split_range(b"same-key-1", b"same-key-9", 4) == [(b"same-key-1", b"same-key-9")]
    got = antientropy.split_range(b"a", b"", 4)
    assert got[0][0] == b"a" and got[-1][1] == b"" and all(x[1] == y[0] for x, y in zip(got, got[1:], strict=False))
    with pytest.raises(ValueError):
        antientropy.split_range(b"", b"", 0)


def test_leaves_find_the_difference(spark):
    rows = [(f"u{i:04d}", str(i)) for i in range(400)]
    a = spark.createDataFrame(rows, "key string, value string")
    b = spark.createDataFrame([(k, "changed" if k == "u0123" else x) for k, x in rows if k != "u0300"], "key string, value string")
    leaves = antientropy.differing_leaves(a, b, b"u0000", b"u0400", leaf_rows=32)
    assert antientropy.differing_leaves(a, a) == []
    hit = lambda k: any(x <= k < y or (x <= k and not y) for x, y in leaves)
    assert hit(b"u0123") and hit(b"u0300")


def test_repair_checks_ownership(spark):
    ranges = spark.createDataFrame([("", "m", ["n1"]), ("m", "", ["n2"])], "start string, end string, replicas array<string>")
    keys = spark.createDataFrame([("a",), ("z",)], "key string")
    with pytest.raises(antientropy.NotOwner):
        antientropy.check_ownership(keys, ranges, "n1")
    assert antientropy.check_ownership(keys.filter("key = 'a'"), ranges, "n1").count() == 1


def test_sizes_of_sketches():
    assert sketches.bloom_size(1000, 0.01) == (9586, 7)
    assert sketches.cms_size(0.01, 0.01) == (272, 5)
    assert sketches.hll_precision(0.01) == 14
    with pytest.raises(ValueError):
        sketches.hll_precision(0.9)


def test_hamming(spark):
    df = spark.createDataFrame([("0" * 64, "1" + "0" * 62 + "1")], "a string, b string")
    assert df.select(sketches.hamming(F.col("a"), F.col("b"))).first()[0] == 2
    with pytest.raises(ValueError):
        sketches.similar(F.col("a"), F.col("b"), 65)


def test_hll_merges(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("x"))
    regs = sketches.hll(df.filter("cast(x as int) < 12000"), "x", 12).union(sketches.hll(df.filter("cast(x as int) >= 8000"), "x", 12))
    n = sketches.hll_estimate(regs.groupBy("idx").agg(F.max("register").alias("register")), 12).first()[0]
    assert abs(n - 20000) < 1000


def test_failure_detector_fold(spark):
    rng = random.Random(3)
    rows = [(t, i, rng.random() > 0.4, rng.random() > 0.8) for t in range(5) for i in range(60)]
    got = {(r["target"], r["tick"]): r["status"] for r in membership.detect(spark.createDataFrame(rows, "target long, tick long, direct_ok boolean, indirect_ok boolean"), 4).collect()}
    for t in range(5):
        status, since = "alive", 0
        for _, i, d, n in (r for r in rows if r[0] == t):
            if status == "dead":
                pass
            elif d or n:
                status = "alive"
            elif status == "alive":
                status, since = "suspect", i
            elif i - since >= 4:
                status = "dead"
            assert got[t, i] == status


def test_guarded_transitions():
    d = membership.Detector("me")
    d.members["x"] = ("alive", 3)
    assert not d.mark("x", 2, "suspect") and d.mark("x", 3, "suspect") and not d.mark("x", 3, "suspect") and d.mark("x", 3, "dead")
    assert not d.mark("me", 0, "suspect")


def test_token_bucket(spark):
    rows = [(1, i, i // 3) for i in range(30)]
    got = [r["allowed"] for r in limits.token_bucket(spark.createDataFrame(rows, "user long, seq long, ts_seconds long"), rate=1.0, most=2).orderBy("seq").collect()]
    tokens, last, want = 2, 0, []
    for _, _, now in rows:
        have = min(2, tokens + (now - last))
        want.append(have >= 1)
        if have >= 1:
            tokens, last = have - 1, now
    assert got == want


def test_config():
    assert config.csv(" a, ,b ") == ("a", "b")
    assert config.load_cluster(env={"KVARN_CLUSTER_NODE_ID": "x", "KVARN_CLUSTER_SEEDS": "a,b"}).seeds == ("a", "b")
    assert config.ClusterConfig().validate().initial_replicas == ("node-1",)
    for bad in ({"read_quorum": 1}, {"merge_bytes": 0}, {"fanout": 1}, {"ping_seconds": 9.0}, {"generation": 0}, {"node_id": ""}):
        with pytest.raises(ValueError):
            config.ClusterConfig(**bad).validate()


def test_config_file_below_environment(tmp_path):
    (tmp_path / "c.json").write_text('{"node_id": "file", "fanout": 8}')
    got = config.load_cluster(str(tmp_path / "c.json"), {"KVARN_CLUSTER_NODE_ID": "env"})
    assert (got.node_id, got.fanout) == ("env", 8)


def test_random_operations_against_a_dict(spark):
    rng = random.Random(5)
    rows, model = [], {}
    for lsn in range(1, 400):
        key, op = f"k{rng.randrange(40)}", 1 if rng.random() < 0.7 else 2
        rows.append((lsn, op, key, str(lsn) if op == 1 else None))
        model.pop(key, None) if op == 2 else model.__setitem__(key, str(lsn))
    log = spark.createDataFrame(rows, "lsn long, op int, key string, value string")
    assert {r["key"]: r["value"] for r in state.live(log).collect()} == model
    parts = [log.filter(F.col("lsn") % 4 == i) for i in range(4)]
    merged = compaction.merge(parts)
    assert {r["key"]: r["value"] for r in state.live(merged).collect()} == model
    final = compaction.merge([merged], last_level=True)
    assert {r["key"]: r["value"] for r in final.collect()} == model and final.filter("op = 2").count() == 0


def test_coordinated_writes_and_reads(spark):
    ranges = spark.createDataFrame([("", "m", ["n1", "n2", "n3"]), ("m", "", ["n2", "n3", "n4"])], "start string, end string, replicas array<string>")
    up = spark.createDataFrame([("n1",), ("n2",), ("n4",)], "node_id string")
    writes = spark.createDataFrame([("a", "1", False, None, 2), ("z", None, True, {"n9": 4}, 3), ("", "x", False, None, 0), ("b", "2", False, None, 4)], "key string, value string, deleted boolean, context map<string,int>, quorum int")
    stored, outcomes = coordination.coordinate_writes(writes, ranges, up, "n1", 2, 77)
    assert {(r["key"], r["acks"], r["status"]) for r in outcomes.collect()} == {("a", 2, "ok"), ("z", 2, "unavailable"), ("", 0, "invalid"), ("b", 2, "invalid")}
    kept = {(r["node_id"], r["key"]): r["envelope"] for r in stored.collect()}
    assert {k for k in kept if k[1] == "a"} == {("n1", "a"), ("n2", "a")} and kept["n2", "z"]["deleted"] and kept["n2", "z"]["value"] == ""
    assert {k: int(v) for k, v in kept["n4", "z"]["vector_clock"].items()} == {"n9": 4, "n1": 1}
    reads = {r["key"]: r for r in coordination.coordinate_reads(spark.createDataFrame([("a",), ("q",), ("z",)], "key string"), ranges, stored, up, 2).collect()}
    assert reads["a"]["status"] == "ok" and reads["a"]["versions"][0]["value"] == "1"
    assert reads["q"]["status"] == "not_found" and reads["z"]["versions"][0]["deleted"]


def test_ownership_gate_and_addresses(spark):
    ranges = spark.createDataFrame([("", "m", ["n1"]), ("m", "", ["n2"])], "start string, end string, replicas array<string>")
    keys = spark.createDataFrame([("a",), ("z",)], "key string")
    assert [r["key"] for r in coordination.owned(keys, ranges, "n1", strict=False).collect()] == ["a"]
    with pytest.raises(PermissionError):
        coordination.owned(keys, ranges, "n1")
    members = spark.createDataFrame([("n1", "host:1")], "node_id string, advertise_addr string")
    got = coordination.with_addresses(spark.createDataFrame([("n1",), ("n7",)], "node_id string"), members).collect()
    assert {tuple(r) for r in got} == {("n1", "host:1"), ("n7", None)}
    e = spark.createDataFrame([("k", versioning.MAGIC + '{"version":1,"vector_clock":{"a":2},"updated_at_unix_nano":5,"deleted":false,"value":"v"}')], "key string, value string")
    assert coordination.decoded(e).first()["envelope"]["value"] == "v"
