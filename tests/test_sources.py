from __future__ import annotations

import pytest

from kvarn.config import EngineConfig
from kvarn.shell import Shell
from kvarn.sources import sstable, wal
from kvarn.sources.store import Conflict, KVStore
from kvarn.streaming import feeds


def test_record_round_trip_and_corruption():
    data = b"".join(wal.encode_record(i, 1, f"k{i}".encode(), b"v" * i) for i in range(1, 5)) + wal.encode_record(5, 2, b"k1")
    assert [r[0] for r in wal.decode_records(data)] == [1, 2, 3, 4, 5]
    assert [r and r[0] for r in wal.decode_records(data[:-5])] == [1, 2, 3, 4, None]
    flipped = data[:-1] + bytes([data[-1] ^ 1])
    assert [r and r[0] for r in wal.decode_records(flipped)][-1] is None
    with pytest.raises(ValueError):
        wal.encode_record(1, 2, b"k", b"v")


def test_segments_are_read_past_a_torn_one(spark, tmp_path):
    one = wal.encode_record(1, 1, b"a", b"x") + wal.encode_record(2, 1, b"b", b"y")
    (tmp_path / "000000001.log").write_bytes(one[:-5])
    (tmp_path / "000000002.log").write_bytes(wal.encode_record(3, 2, b"a"))
    (tmp_path / "other.log").write_bytes(b"junk")
    rows = wal.read(spark, str(tmp_path)).orderBy("segment", "lsn").collect()
    assert sorted((r["lsn"] or 0, r["key"], r["corrupt"]) for r in rows) == [(0, None, True), (1, "a", False), (3, "a", False)]
    assert [r[0] for r in wal.purgeable(wal.read(spark, str(tmp_path)), 5).collect()] == [1]


def test_table_files(spark, tmp_path):
    items = [(f"k{i:04d}".encode(), b"v" * (i % 50)) for i in range(500)] + [(b"jumbo", b"z" * 20000), (b"", b"empty key"), (b"gone", b"<DELETED!>")]
    data = sstable.write(items, 77)
    assert list(sstable.entries(data)) == sorted(items) and sstable.footer(data)["items"] == len(items)
    (tmp_path / "sstable_1.db").write_bytes(data)
    got = sstable.read(spark, str(tmp_path))
    assert got.count() == len(items) and got.filter("op = 2").first()["key"] == "gone" and got.first()["max_lsn"] == 77
    with pytest.raises(ValueError):
        sstable.footer(data[:-1] + b"\0")


def test_table_ranges_by_index(spark, tmp_path, monkeypatch):
    items = [(f"k{i:05d}".encode(), b"v" * (i % 90)) for i in range(3000)] + [(b"k01000x", b"z" * 20000)]
    data = sstable.write(items, 7)
    assert [k for k, _ in sstable.sparse_index(data)] == sorted(k for k, _ in sstable.sparse_index(data))
    for a, b in ((b"", None), (b"k00500", b"k00510"), (b"k01000", b"k01001"), (b"k01000x", b"k01000x"), (b"k02999", None), (b"a", b"b"), (b"z", None), (b"k00700a", b"k00700b")):
        assert list(sstable.between(data, a, b)) == [x for x in sorted(items) if x[0] >= a and (b is None or x[0] <= b)]
    read = []
    monkeypatch.setattr(sstable, "entries", lambda d, first=0, plain=sstable.entries: (read.append(x[0]) or x for x in plain(d, first)))
    assert list(sstable.between(data, b"k02000", b"k02000")) == [(b"k02000", b"v" * 20)] and len(read) < 200
    monkeypatch.undo()
    (tmp_path / "a.db").write_bytes(data)
    (tmp_path / "b.db").write_bytes(sstable.write([(b"k00001", b"newer"), (b"k00002", b"<DELETED!>")], 9))
    (tmp_path / "c.db.tmp").write_bytes(b"torn")
    assert [sstable.get(spark, str(tmp_path), k) for k in ("k00001", "k00002", "k00003", "none")] == ["newer", None, "vvv", None]
    assert sstable.prefix_scan(spark, str(tmp_path), "k0100").count() == 11
    assert len(sstable.clean_unfinished(spark, str(tmp_path))) == 1 and not sstable.clean_unfinished(spark, str(tmp_path))


def test_store(spark, tmp_path):
    s = KVStore(spark, str(tmp_path), EngineConfig(lsm_levels=3, compaction_threshold=2))
    assert s.get("a") is None and s.commit() == 0
    s.put("a", "1")
    s.put("b", "2")
    assert s.commit() == 2
    s.delete("a")
    s.put("c", "<DELETED!>")
    assert s.commit() == 4
    assert s.get("a") is None and s.get("b") == "2"
    pin = s.snapshot()
    s.flush()
    s.put("a", "3")
    s.commit()
    s.flush()
    for i in range(2):
        s.put(f"d{i}", "x")
        s.commit()
        s.flush()
    before = sorted(map(tuple, s.state().collect()))
    assert s.compact() >= 1
    assert sorted(map(tuple, s.state().collect())) == before
    assert {r["key"] for r in s.state(pin).collect()} == {"b"}
    assert {r["key"] for r in s.state(at_lsn=2).collect()} >= {"b"}
    kept = s.vacuum()
    assert {r["key"] for r in s.state(pin).collect()} == {"b"} and isinstance(kept, list)
    s.release(pin)
    assert [k for k, _ in s.prefix_iterate("d")] == ["d0", "d1"]
    assert s.range_scan("a", "b").count() == 2 and s.prefix_scan("d", 2, 1).first()["key"] == "d1"
    assert s.tail(5).count() >= 2


def test_two_writers_conflict(spark, tmp_path):
    a, b = KVStore(spark, str(tmp_path)), KVStore(spark, str(tmp_path))
    stale = b.manifest()
    a.put("k", "v")
    a.commit()
    with pytest.raises(Conflict):
        b._install(stale)
    assert not [p for p in (tmp_path / "manifest").iterdir() if p.name.endswith(".tmp")]


def test_iterator_protocol(spark, tmp_path):
    s = KVStore(spark, str(tmp_path))
    for k in "abc":
        s.put(k, k.upper())
    s.commit()
    it = s.range_iterate("a", "b")
    assert it.next() == ("a", "A", True) and it.next() == ("b", "B", False) and it.next() is None
    it.reset()
    assert it.has_next()
    it.stop()
    assert not it.has_next() and it.next() is None


def test_shell(spark, tmp_path):
    sh = Shell(KVStore(spark, str(tmp_path)))
    assert sh.run('PUT "a b" "c d"') == "ok" and sh.run('get "a b"') == "c d"
    assert sh.run("PREFIX_SCAN a 1 10") == "a b\tc d" and sh.run("prefix_scan a 0 10").startswith("error")
    assert sh.run("GET").startswith("usage: GET") and sh.run("what").startswith("unknown") and sh.run("") == ""
    assert sh.run("PREFIX_ITERATE a") == "iterator open" and sh.run("has_next") == "true" and sh.run("next") == "a b\tc d" and sh.run("next") == "end" and sh.run("stop") == "stopped"
    assert sh.run("DEL 'a b'") == "ok" and sh.run("GET 'a b'") == "not found" and sh.run("QUIT") is None


def test_stream_into_a_store(spark, tmp_path):
    src = KVStore(spark, str(tmp_path / "a"))
    for i in range(6):
        src.put(f"k{i % 3}", str(i))
        src.commit()
    to = KVStore(spark, str(tmp_path / "b"))
    log = feeds.commits(spark, str(tmp_path / "a"), files_per_batch=2)
    feeds.materialise(log, to, str(tmp_path / "c")).awaitTermination(120)
    assert {r["key"]: (r["value"], r["lsn"]) for r in to.state().collect()} == {"k0": ("3", 4), "k1": ("4", 5), "k2": ("5", 6)}
    n = to.manifest()["version"]
    feeds.materialise(log, to, str(tmp_path / "c")).awaitTermination(120)
    assert to.manifest()["version"] == n


def test_late_changes_lose_to_newer_ones(spark, tmp_path):
    row = lambda lsn, value, op=1: spark.createDataFrame([(lsn, op, "k", value)], "lsn long, op int, key string, value string")
    src, to = KVStore(spark, str(tmp_path / "a")), KVStore(spark, str(tmp_path / "b"))
    src.append(row(9, "new"))
    src.append(row(3, "old"))
    log = feeds.commits(spark, str(tmp_path / "a"), files_per_batch=1)
    feeds.materialise(log, to, str(tmp_path / "c")).awaitTermination(120)
    assert [(r["value"], r["lsn"]) for r in to.state().collect()] == [("new", 9)] and src.get("k") == "new"
    src.append(row(10, None, 2))
    src.append(row(9, "new"))
    feeds.materialise(log, to, str(tmp_path / "c")).awaitTermination(120)
    assert to.state().count() == 0 and to.manifest()["max_lsn"] == 10


def test_files_of_failed_commits_are_not_followed(spark, tmp_path):
    src, to = KVStore(spark, str(tmp_path / "a")), KVStore(spark, str(tmp_path / "b"))
    src.put("k", "v")
    src.commit()
    orphan = spark.createDataFrame([(5, 1, "k", "wrong")], "lsn long, op int, key string, value string").selectExpr("lsn", "cast(op as byte) as op", "key", "value")
    orphan.write.parquet(str(tmp_path / "a" / "log" / "orphan"))
    feeds.materialise(feeds.commits(spark, str(tmp_path / "a")), to, str(tmp_path / "c")).awaitTermination(120)
    assert to.get("k") == "v"
    assert src.vacuum() == [] and any("orphan" in p for p in src.vacuum(orphans_after=0)) and src.get("k") == "v"


def test_pins_are_seen_by_other_processes(spark, tmp_path):
    a, b = KVStore(spark, str(tmp_path)), KVStore(spark, str(tmp_path))
    a.put("k", "1")
    a.commit()
    pin = a.snapshot()
    a.put("k", "2")
    a.commit()
    a.flush()
    b.vacuum()
    assert b.pinned() == {pin} and [r["value"] for r in a.state(pin).collect()] == ["1"]
    a.release(pin)
    assert not b.pinned()
    b.snapshot()
    a.unpin(a.manifest()["version"])
    assert not b.pinned()
    b.vacuum()
    assert b.versions() == [a.manifest()["version"]] and a.get("k") == "2"


def test_stream_limiter(spark, tmp_path):
    rows = [(1, i, i // 3) for i in range(12)]
    spark.createDataFrame(rows, "user long, seq long, ts_seconds long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user long, seq long, ts_seconds long").parquet(str(tmp_path / "in"))
    q = feeds.limited(stream, rate=1.0, most=2).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    from kvarn.operators import limits

    want = {r["seq"]: r["allowed"] for r in limits.token_bucket(spark.createDataFrame(rows, "user long, seq long, ts_seconds long"), 1.0, 2).collect()}
    assert {r["seq"]: r["allowed"] for r in spark.table("limited").collect()} == want


def test_node_refuses_what_it_does_not_own(spark, tmp_path):
    from kvarn.operators import coordination, versioning
    from kvarn.operators.ring import Range, RangeTable, from_rows, to_rows
    from kvarn.sources.node import FailedPrecondition, Node
    from pyspark.sql import functions as F

    ranges = [Range("", "m", ("a", "b"), 3, "p"), Range("m", "", ("b",), 2, "p")]
    assert from_rows(to_rows(spark, ranges[::-1])) == ranges
    with pytest.raises(ValueError):
        from_rows(to_rows(spark, ranges[:1]))
    node = Node("a", KVStore(spark, str(tmp_path)), RangeTable(ranges))
    assert node.put("c", "1") == 1 and node.get("c") == "1" and node.delete("c") == 2 and node.get("c") is None
    for call in (lambda: node.put("x", "1"), lambda: node.get("m"), lambda: node.range_scan("c", "n"), lambda: node.stream_range("", "")):
        with pytest.raises(FailedPrecondition):
            call()
    for call in (lambda: node.put("", "1"), lambda: node.range_scan("a", "b", 0), lambda: node.range_scan("a", "b", 1, 5000)):
        with pytest.raises(coordination.InvalidRequest):
            call()
    text = spark.range(1).select(versioning.encode(versioning.envelope(F.create_map(F.lit("n"), F.lit(1)), F.lit(5), F.lit(False), F.lit("v")))).first()[0]
    node.put("d", text)
    node.put("e", "plain")
    assert node.range_scan("", "m").count() == 2 and [r["envelope"]["value"] for r in node.stream_range("", "m").collect()] == ["v"]
    assert node.health()["epoch"] == 3 and node.owned() == [("", "m")]
    out = spark.createDataFrame([("b", "unavailable"), ("a", "ok"), ("c", "invalid")], "key string, status string")
    with pytest.raises(coordination.Unavailable):
        coordination.checked(out)
    assert coordination.checked(out.filter("key = 'a'")).count() == 1


def test_store_options(spark, tmp_path):
    from kvarn.sources.store import RateLimited

    s = KVStore(spark, str(tmp_path / "a"), EngineConfig(wal_mode="sync", max_tokens=2, token_refill_rate=0.0, lsm_levels=2, compaction_threshold=2), limited=True, compaction=False)
    s.put("a", "1", user="u")
    assert s.durable_lsn() == s.appended_lsn() == 1
    s.delete("a", user="u")
    with pytest.raises(RateLimited):
        s.put("b", "1", user="u")
    s.put("b", "1", user="other")
    s.put("c", "1")
    assert s.durable_lsn() == 4
    for k in "xy":
        s.put(k, "1")
        s.flush()
    assert s.compact() == 0 and s.stats()["tables"][0] == 2
    g = KVStore(spark, str(tmp_path / "b"), EngineConfig(wal_write_buffer=10))
    g.put("a", "1")
    assert (g.durable_lsn(), g.appended_lsn()) == (0, 1)
    g.put("b", "123456789")
    assert g.durable_lsn() == 2
