"""The registered queries over the driver's tables and the SQL they are compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvarn.operators import antientropy, compaction, coordination, limits, membership, ring, scan, sketches, state, tablet, versioning
from kvarn.session import scratch
from kvarn.sources import views, wal
from kvarn.sources.store import KVStore
from kvarn.streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LOG = """kv_log as (select event_id+1 as lsn, concat('u',lpad(cast(user_id as varchar),6,'0'),'/',lpad(cast(event_id%16 as varchar),2,'0')) as key,
 case when event_type='error' then 2 else 1 end as op, case when event_type='error' then null else concat(event_type,':',props) end as value, event_id, event_type from events),
 kv_last as (select * from (select *, row_number() over (partition by key order by lsn desc) rn from kv_log) t where rn=1),
 kv_state as (select key, value, lsn from kv_last where op=1)"""
_CLOCK = (
    _LOG
    + """, kv_clock as (select lsn, key, op, value, event_id,
 sum(case when event_id%3=0 then 1 else 0 end) over w * case when event_type='signup' and event_id%3<>0 then 0 else 1 end as c0,
 sum(case when event_id%3=1 then 1 else 0 end) over w * case when event_type='signup' and event_id%3<>1 then 0 else 1 end as c1,
 sum(case when event_id%3=2 then 1 else 0 end) over w * case when event_type='signup' and event_id%3<>2 then 0 else 1 end as c2
 from kv_log window w as (partition by key order by lsn rows between unbounded preceding and current row)),
 kv_replica as (select r, key, op, value, lsn, c0, c1, c2 from (select k.*, r.r, row_number() over (partition by r.r, key order by lsn desc) rn
 from kv_clock k join (select 1 as r union all select 2 union all select 3) r on (k.event_id*7+r.r*3)%10<>0) t where rn=1),
 pair as (select coalesce(a.key,b.key) as key, a.key as ak, b.key as bk,
 case when a.key is null then 'missing_here' when b.key is null then 'missing_there' when a.c0=b.c0 and a.c1=b.c1 and a.c2=b.c2 then 'equal'
 when a.c0<=b.c0 and a.c1<=b.c1 and a.c2<=b.c2 then 'before' when a.c0>=b.c0 and a.c1>=b.c1 and a.c2>=b.c2 then 'after' else 'concurrent' end as relation
 from (select * from kv_replica where r=1) a full join (select * from kv_replica where r=2) b on a.key=b.key),
 kept as (select v.* from kv_replica v where not exists (select 1 from kv_replica o where o.key=v.key and o.r<>v.r and
 ((v.c0<=o.c0 and v.c1<=o.c1 and v.c2<=o.c2 and not (v.c0=o.c0 and v.c1=o.c1 and v.c2=o.c2)) or (o.r<v.r and v.c0=o.c0 and v.c1=o.c1 and v.c2=o.c2))))"""
)
_RANGES = """ranges as (select * from (values ('','u000040/00','n1,n2,n3'),('u000040/00','u000080/00','n2,n3,n4'),('u000080/00','u000120/00','n3,n4,n5'),('u000120/00','','n1,n4,n5')) t(s,e,reps))"""
_HALF = "(s='' or key>=s) and (e='' or key<e)"


def query(sql: str | None = None, name: str | None = None):
    """Register a query and, where SQL can express it, its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _log(spark, sf):
    return views.kv_log(spark, sf)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_page(spark, sf_dir)


# ---- state and lookups


@query(f"with {_LOG} select key, value, lsn from kv_state")
def lww_state(spark, sf):
    return state.live(_log(spark, sf))


@query(f"with {_LOG} select key, value, lsn from kv_state where key='u000005/03'")
def point_get(spark, sf):
    return state.get(_log(spark, sf), "u000005/03")


_ASKED = "concat('u',lpad(cast(c_custkey%200 as varchar),6,'0'),'/',lpad(cast(c_custkey%16 as varchar),2,'0'))"


@query(f"with {_LOG}, asked as (select distinct {_ASKED} as key from customer) select a.key, s.lsn is not null as found, s.value from asked a left join kv_state s on a.key=s.key")
def multi_get(spark, sf):
    c = views.table(spark, sf, "customer")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return state.multi_get(_log(spark, sf), c.select(F.concat(F.lit("u"), pad(F.col("c_custkey") % 200, 6), F.lit("/"), pad(F.col("c_custkey") % 16, 2)).alias("key")))


@query(f"with {_LOG} select key, lsn from kv_last where op=2")
def deleted_keys(spark, sf):
    return state.deleted(_log(spark, sf))


@query(f"with {_LOG} select count(*) as n_live, cast(min(lsn) as bigint) as min_lsn, cast(max(lsn) as bigint) as max_lsn from kv_state")
def state_stats(spark, sf):
    return state.live(_log(spark, sf)).agg(F.count("*").alias("n_live"), F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"))


# ---- scans


@query(f"with {_LOG} select key, value, lsn from kv_state where key like 'u00001%'")
def prefix_scan(spark, sf):
    return state.live(scan.prefix(_log(spark, sf), "u00001"))


@query(f"with {_LOG} select key, value from kv_state where key like 'u0000%' order by key limit 25 offset 25")
def prefix_page(spark, sf):
    return scan.page(state.live(scan.prefix(_log(spark, sf), "u0000")).select("key", "value"), 2, 25)


@query(f"with {_LOG} select key, value, lsn from kv_state where key between 'u000010/00' and 'u000020/15'")
def range_scan(spark, sf):
    return state.live(scan.inclusive(_log(spark, sf), "u000010/00", "u000020/15"))


@query(f"with {_LOG} select key, value from kv_state where key between 'u000005/00' and 'u000060/15' order by key limit 40 offset 80")
def range_page(spark, sf):
    return scan.page(state.live(scan.inclusive(_log(spark, sf), "u000005/00", "u000060/15")).select("key", "value"), 3, 40)


@query(f"with {_LOG} select key, value, lsn from kv_state where key>='u000010/00' and key<'u000020/00'")
def half_open_scan(spark, sf):
    return state.live(scan.half_open(_log(spark, sf), "u000010/00", "u000020/00"))


@query(f"with {_LOG} select key, value, lsn from kv_state where key>='u000100/00'")
def unbounded_scan(spark, sf):
    return state.live(scan.half_open(_log(spark, sf), "u000100/00", ""))


@query(f"with {_LOG} select key, value from kv_state where key between 'u000020/00' and 'u000010/00'")
def empty_range(spark, sf):
    return state.live(scan.inclusive(_log(spark, sf), "u000020/00", "u000010/00")).select("key", "value")


@query(f"with {_LOG} select key, value from kv_state where key like 'u00001%' order by key limit 1000 offset 100000000")
def page_past_end(spark, sf):
    return scan.page(state.live(scan.prefix(_log(spark, sf), "u00001")).select("key", "value"), 100_001, 1000)


@query(f"with {_LOG} select key, value, row_number() over (partition by substr(key,1,7) order by key) as position, lead(key) over (partition by substr(key,1,7) order by key) is not null as has_next from kv_state")
def iterator_order(spark, sf):
    w = Window.partitionBy(F.substring("key", 1, 7)).orderBy("key")
    return state.live(_log(spark, sf)).select("key", "value", F.row_number().over(w).cast("long").alias("position"), F.lead("key").over(w).isNotNull().alias("has_next"))


# ---- log, snapshots, compaction


@query(f"with {_LOG} select key, value, lsn from (select *, row_number() over (partition by key order by lsn desc) r2 from kv_log where lsn<=5000) t where r2=1 and op=1")
def snapshot_at_lsn(spark, sf):
    return state.live(_log(spark, sf), at_lsn=5000)


@query(f"with {_LOG} select lsn, key, op, value from kv_log where lsn>700 and lsn<=1200")
def log_tail_after_lsn(spark, sf):
    return _log(spark, sf).filter("lsn > 700 and lsn <= 1200").select("lsn", "key", "op", "value")


_MERGED = "select key, op, value, lsn from (select *, row_number() over (partition by key order by lsn desc) r2 from kv_log ) t where r2=1"


def _level_tables(spark, sf) -> list[DataFrame]:
    log = _log(spark, sf)
    return [log.filter((F.col("lsn") - 1) % 4 == i) for i in range(4)]


@query(f"with {_LOG} {_MERGED}")
def compact_levels(spark, sf):
    return compaction.merge(_level_tables(spark, sf))


@query(
    f"with {_LOG}, m as ({_MERGED}), top as (select max(lsn) as top from kv_log), cases as (select * from (values ('inner',0),('last_open',0),('last_reached',1000000000),('last_ahead',1)) t(gate,safe)) "
    "select gate, cast(count(*) as bigint) as n, cast(sum(case when op=2 then 1 else 0 end) as bigint) as tombstones from m cross join top cross join cases where not (op=2 and gate<>'inner' and (safe=0 or (top>0 and top<=safe))) group by gate"
)
def tombstone_gc_gate(spark, sf):
    tables = _level_tables(spark, sf)
    out = None
    for gate, last, safe in (("inner", False, 0), ("last_open", True, 0), ("last_reached", True, 1_000_000_000), ("last_ahead", True, 1)):
        part = compaction.merge(tables, last, safe).groupBy(F.lit(gate).alias("gate")).agg(F.count("*").alias("n"), F.count_if(F.col("op") == 2).alias("tombstones"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "with m as (select cast(o_orderkey%4 as int) as level, cast(o_orderkey as varchar) as path, o_orderkey as seq from orders), n as (select *, row_number() over (partition by level order by seq)-1 as r, count(*) over (partition by level) as c from m where level<3) "
    "select level, cast(r//4 as bigint) as batch, path, seq from n where r < (c//4)*4"
)
def compaction_plan(spark, sf):
    o = views.table(spark, sf, "orders")
    return compaction.plan(o.select((F.col("o_orderkey") % 4).cast("int").alias("level"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").alias("seq")))


@query(
    f"with {_LOG}, s as (select (lsn-1)//100 as segment, min(lsn) as min_lsn, max(lsn) as max_lsn, count(*) as n from kv_log group by 1) "
    "select segment, min_lsn, max_lsn, n, max_lsn<=750 and segment<(select max(segment) from s) as purged from s"
)
def log_retention(spark, sf):
    return compaction.retention(_log(spark, sf), 750, 100)


@query(
    f"with {_LOG}, b as (select lsn, strlen(key)+coalesce(strlen(value),0) as b from kv_log), u as (select *, sum(b) over (order by lsn) as upto from b) "
    "select cast((upto-b)//1000 as bigint) as batch, count(*) as n, cast(sum(b) as bigint) as bytes, max(lsn) as max_lsn from u group by 1"
)
def memtable_roll(spark, sf):
    return state.memtable_batches(_log(spark, sf))


@query(f"with {_LOG} select (lsn-1)//256 as batch, count(*) as n, min(lsn) as first_lsn, max(lsn) as durable_lsn from kv_log group by 1")
def batch_group_commit(spark, sf):
    return state.group_commits(_log(spark, sf))


@query("select row_number() over (order by o_orderkey)+500 as lsn, o_orderkey from orders")
def lsn_assignment(spark, sf):
    return state.assign_lsn(views.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 500, 4096).select("lsn", "o_orderkey")


# ---- tablets

_TABLET = "substr(key,1,5)"


def _tablets(spark, sf):
    return state.live(_log(spark, sf)).withColumn("tablet", F.substring("key", 1, 5))


@query(f"with {_LOG} select {_TABLET} as tablet, count(*) as n, cast(sum(strlen(key)+coalesce(strlen(value),0)) as bigint) as bytes from kv_state group by 1")
def tablet_size(spark, sf):
    return tablet.sizes(_tablets(spark, sf))


@query(
    f"with {_LOG}, k as (select {_TABLET} as tablet, key, strlen(key)+coalesce(strlen(value),0) as b from kv_state), p as (select *, sum(b) over (partition by tablet order by key)-b as passed, sum(b) over (partition by tablet) as total from k) "
    "select tablet, key as boundary from (select *, row_number() over (partition by tablet order by abs(total-2*passed), key) rn from p where passed>0) t where rn=1"
)
def tablet_split_boundary(spark, sf):
    return tablet.split_boundaries(_tablets(spark, sf))


@query(
    f"with {_LOG}, t as (select {_TABLET} as start, cast(sum(strlen(key)+coalesce(strlen(value),0)) as bigint) as bytes from kv_state group by 1), p as (select start, bytes, lead(start) over (order by start) as rs, lead(bytes) over (order by start) as rb from t) "
    "select start as left_start, rs as right_start, bytes+rb as bytes from p where rs is not null and bytes<=40000 and rb<=40000"
)
def tablet_merge_candidates(spark, sf):
    return tablet.merge_candidates(tablet.sizes(_tablets(spark, sf)).withColumnRenamed("tablet", "start"), 40000)


_OBS = "select o_custkey%10 as range, o_orderkey as tick, case when o_orderkey%7=0 then 2 else 1 end as generation from orders"


@query(
    f"with o as ({_OBS}), n as (select *, case when lag(generation) over w is null or lag(generation) over w<>generation or tick<>lag(tick) over w+1 then 1 else 0 end as new from o window w as (partition by range order by tick)), "
    "i as (select *, sum(new) over (partition by range order by tick) as island from n) select range, tick, row_number() over (partition by range, island order by tick) as run, row_number() over (partition by range, island order by tick)>=2 as settled from i"
)
def settled_ticks(spark, sf):
    o = views.table(spark, sf, "orders")
    obs = o.select((F.col("o_custkey") % 10).alias("range"), F.col("o_orderkey").alias("tick"), F.when(F.col("o_orderkey") % 7 == 0, 2).otherwise(1).alias("generation"))
    return tablet.settled(obs, 2).withColumn("run", F.col("run").cast("long"))


@query(
    f"with {_RANGES}, nodes as (select distinct concat('s', cast(s_suppkey%8 as varchar)) as node_id from supplier), p as (select s, e, node_id, row_number() over (partition by s, e order by md5(concat(s,chr(31),e,chr(31),node_id)) desc, node_id) as position from ranges cross join nodes) "
    'select s as start, e as "end", node_id, position from p where position<=3'
)
def replica_placement(spark, sf):
    nodes = views.table(spark, sf, "supplier").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 8).cast("string")).alias("node_id"))
    return tablet.placements(views.ranges(spark), nodes, 3).withColumn("position", F.col("position").cast("long"))


@query()
def replica_assignment(spark, sf):
    """Rendezvous placement with XXH64 scores, which SQL has not."""
    nodes = [f"n{i}" for i in range(1, 7)]
    out = []
    for r in views.ranges(spark).collect():  # the map
        for position, node in enumerate(tablet.assign_replicas(r["start"], r["end"], nodes, r["replicas"], 3), 1):
            out.append((r["start"], r["end"], node, position))
    return spark.createDataFrame(out, "start string, end string, node_id string, position int")


# ---- ring


@query(f"with {_LOG}, {_RANGES} select key, s as range_start, reps as replicas from kv_state join ranges on {_HALF}")
def range_owner_lookup(spark, sf):
    return ring.owners(state.live(_log(spark, sf)).select("key"), views.ranges(spark)).select("key", "range_start", F.array_join("replicas", ",").alias("replicas"))


@query(f"with {_LOG}, {_RANGES} select key, unnest(string_split(reps,',')) as node_id from kv_state join ranges on {_HALF}")
def fanout_owners(spark, sf):
    return coordination.fan_out(state.live(_log(spark, sf)).select("key"), views.ranges(spark))


_SCANS = "select c_custkey as id, concat('u',lpad(cast(c_custkey%150 as varchar),6,'0'),'/00') as a, concat('u',lpad(cast(c_custkey%150+c_custkey%9 as varchar),6,'0'),'/00') as b from customer"


def _scans(spark, sf):
    c, pad = views.table(spark, sf, "customer"), lambda x: F.concat(F.lit("u"), F.lpad(x.cast("string"), 6, "0"), F.lit("/00"))
    k = F.col("c_custkey")
    return c.select(k.alias("id"), pad(k % 150).alias("start"), pad(k % 150 + k % 9).alias("end"))


@query(f"with {_RANGES}, q as ({_SCANS}) select id, s as closed_start, reps as closed_owners from q left join ranges on (s='' or a>=s) and (e='' or b<e)")
def scan_single_owner(spark, sf):
    return ring.holders(_scans(spark, sf), views.ranges(spark), closed=True).select("id", F.col("range_start").alias("closed_start"), F.array_join("replicas", ",").alias("closed_owners"))


@query(f"with {_RANGES}, q as ({_SCANS}) select id, s as range_start, reps as owners from q left join ranges on (s='' or a>=s) and (e='' or (b<>'' and b<=e))")
def half_open_single_owner(spark, sf):
    return ring.holders(_scans(spark, sf), views.ranges(spark), closed=False).select("id", "range_start", F.array_join("replicas", ",").alias("owners"))


# two maps with boundaries at tablets' first keys
_MAPS = (
    _LOG
    + """, ta as (select substr(key,1,5) as t, count(*) as n from kv_state group by 1), tb as (select substr(key,1,6) as t, count(*) as n from kv_state where cast(substr(key,6,1) as int)%3=0 group by 1),
 am as (select *, lead(s,1,'') over (order by s) as e from (select case when t=(select min(t) from ta) then '' else t end as s, n, n%3+1 as g, concat('a', cast(n%2 as varchar)) as p from ta) x),
 bm as (select *, lead(s,1,'') over (order by s) as e from (select case when t=(select min(t) from tb) then '' else t end as s, n, n%4+1 as g, concat('b', cast(n%2 as varchar)) as p from tb) x),
 pieces as (select s, lead(s,1,'') over (order by s) as e from (select s from am union select s from bm) c),
 both_ as (select pieces.s, pieces.e, am.g as lg, am.p as lp, am.s as ls, am.e as le, bm.g as rg, bm.p as rp, bm.s as rs, bm.e as re from pieces join am on (am.s='' or pieces.s>=am.s) and (am.e='' or pieces.s<am.e) join bm on (bm.s='' or pieces.s>=bm.s) and (bm.e='' or pieces.s<bm.e)),
 won as (select *, lg>rg or (lg=rg and (lp<rp or (lp=rp and (ls<rs or (ls=rs and le<=re))))) as l from both_),
 picked as (select s, e, case when l then lg else rg end as g, case when l then lp else rp end as p, case when l then ls else rs end as src, l, lg=rg as tied from won),
 bumped as (select distinct p, g from picked where tied),
 merged as (select picked.s, picked.e, picked.g+case when bumped.p is null then 0 else 1 end as g, picked.p, src, l from picked left join bumped on bumped.p=picked.p and bumped.g=picked.g)"""
)


def _map(spark, sf, chars: int, step: int, levels: int, name: str) -> DataFrame:
    """Tablets by the first characters of live keys as a map; generations and proposals by the number of keys."""
    keys = state.live(_log(spark, sf)).select(F.substring("key", 1, chars).alias("t"))
    n = keys.filter(F.substring("t", chars, 1).cast("int") % step == 0).groupBy("t").agg(F.count("*").alias("n"))
    w = Window.orderBy("t")  # a row for each tablet
    own = n.select(F.when(F.row_number().over(w) == 1, "").otherwise(F.col("t")).alias("start"), F.coalesce(F.lead("t").over(w), F.lit("")).alias("end"), "n")
    return own.select("start", "end", F.array(F.lit("n1"), F.lit("n2")).alias("replicas"), (F.col("n") % levels + 1).alias("generation"), F.concat(F.lit(name), (F.col("n") % 2).cast("string")).alias("proposal_id"), "n")


def _maps(spark, sf):
    return _map(spark, sf, 5, 1, 3, "a"), _map(spark, sf, 6, 3, 4, "b")


_WRONG = "x as (select s, case when n%5=0 then concat(e,'x') else e end as e, case when n%7=0 then 0 else g end as g, case when n%3=0 then '' else p end as p, n%4=0 as bare from am where s<>''), v as (select *, lead(s) over (order by s) as nx, row_number() over (order by s) as rn from x)"


@query(
    f"with {_MAPS}, {_WRONG} select s as start, 'bounded_start' as code from v where rn=1 and s<>'' union all select s, 'bounded_end' from v where nx is null and e<>'' union all select s, 'not_contiguous' from v where nx is not null and (e='' or e<>nx) "
    "union all select s, 'degenerate' from v where s<>'' and e<>'' and s>=e union all select s, 'generation' from v where g<=0 union all select s, 'proposal_id' from v where p='' union all select s, 'replicas' from v where bare"
)
def range_map_validate(spark, sf):
    """A map with faults put in by the number of keys."""
    n = F.col("n")
    wrong = _maps(spark, sf)[0].filter("start <> ''").select(
        "start", F.when(n % 5 == 0, F.concat("end", F.lit("x"))).otherwise(F.col("end")).alias("end"), F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("replicas")).alias("replicas"),
        F.when(n % 7 == 0, 0).otherwise(F.col("generation")).alias("generation"), F.when(n % 3 == 0, "").otherwise(F.col("proposal_id")).alias("proposal_id"),
    )
    return ring.violations(wrong)


def _rows(spark, ranges):
    return spark.createDataFrame([(r.start, r.end, list(r.replicas), r.generation, r.proposal_id) for r in ranges], "start string, end string, replicas array<string>, generation long, proposal_id string")


@query(f"with {_MAPS} select s as start, e as \"end\", cast(g as int) as generation, p as proposal_id from merged")
def range_map_merge(spark, sf):
    return ring.overlay(*_maps(spark, sf)).select("start", "end", F.col("generation").cast("int").alias("generation"), "proposal_id")


@query(
    f"with {_MAPS}, i as (select *, sum(new) over (order by s) as island from (select *, case when src=lag(src) over w and l=lag(l) over w and g=lag(g) over w then 0 else 1 end as new from merged window w as (order by s)) t) "
    "select min(s) as start, case when max(case when e='' then 1 else 0 end)=1 then '' else max(e) end as \"end\", cast(max(g) as int) as generation, max(p) as proposal_id from i group by island"
)
def range_map_coalesced(spark, sf):
    a, b = ([ring.Range(r["start"], r["end"], tuple(r["replicas"]), r["generation"], r["proposal_id"]) for r in m.orderBy("start").collect()] for m in _maps(spark, sf))  # a row for each tablet
    return _rows(spark, ring.merge_maps(a, b)[0]).select("start", "end", F.col("generation").cast("int").alias("generation"), "proposal_id")


def _two_maps():
    a = [ring.Range("", "m", ("n1", "n2"), 2, "a"), ring.Range("m", "", ("n1", "n2"), 2, "a")]
    b = [ring.Range("", "n", ("n2", "n3"), 2, "b"), ring.Range("n", "t", ("n2", "n3"), 3, "b"), ring.Range("t", "", ("n2", "n3"), 2, "b")]
    return a, b


@query()
def proposal_id(spark, sf):
    a, b = _two_maps()
    return spark.createDataFrame([("a", ring.proposal_id(a)), ("b", ring.proposal_id(b)), ("b reversed", ring.proposal_id(b[::-1]))], "map string, proposal_id string")


# ---- versions


@query(f"with {_CLOCK} select key, relation from pair where ak is not null and bk is not null")
def clock_relation(spark, sf):
    r = views.kv_replica(spark, sf)
    a, b = (r.filter(F.col("r") == i).select("key", F.col("vector_clock").alias(f"v{i}")) for i in (1, 2))
    return a.join(b, "key").select("key", versioning.compare(F.col("v1"), F.col("v2")).alias("relation"))


@query(f"with {_CLOCK} select key, cast(max(c0) as bigint) as c0, cast(max(c1) as bigint) as c1, cast(max(c2) as bigint) as c2 from kv_replica group by key")
def clock_merge_max(spark, sf):
    r = views.kv_replica(spark, sf).groupBy("key").agg(versioning.merge_all(F.collect_list("vector_clock")).alias("m"))
    return r.select("key", *[F.element_at("m", n).cast("long").alias(f"c{i}") for i, n in enumerate(views.NODES)])


def _reconciled(spark, sf):
    r = views.kv_replica(spark, sf).groupBy("key").agg(versioning.in_order(F.collect_list(F.struct("r", "lsn", "op", "value", "vector_clock")), "r").alias("vs"))
    return r.select("key", versioning.reconcile(F.col("vs")).alias("kept"))


@query(f"with {_CLOCK} select key, r, lsn, op, value, count(*) over (partition by key) as siblings from kept")
def reconcile_versions(spark, sf):
    k = _reconciled(spark, sf)
    return k.select("key", F.size("kept").cast("long").alias("siblings"), F.explode("kept").alias("v")).select("key", "v.r", "v.lsn", "v.op", "v.value", "siblings")


@query(f"with {_CLOCK} select key, cast(max(c0) as bigint) as c0, cast(max(c1) as bigint) as c1, cast(max(c2) as bigint) as c2, count(*) as siblings from kept group by key")
def reconcile_context(spark, sf):
    k = _reconciled(spark, sf).withColumn("m", versioning.merge_all(F.transform("kept", lambda v: v["vector_clock"])))
    return k.select("key", *[F.element_at("m", n).cast("long").alias(f"c{i}") for i, n in enumerate(views.NODES)], F.size("kept").cast("long").alias("siblings"))


@query(f"with {_CLOCK} select key, lsn, value from (select *, row_number() over (partition by key order by lsn//50 desc, case when op=2 then 1 else 0 end desc, coalesce(value,'') desc, lsn desc) r2 from kv_replica) t where r2=1")
def pick_by_timestamp(spark, sf):
    r = views.kv_replica(spark, sf)
    env = versioning.envelope(F.col("vector_clock"), F.floor(F.col("lsn") / 50) + 1, F.col("op") == 2, F.col("value")).withField("lsn", F.col("lsn"))
    picked = r.groupBy("key").agg(versioning.in_order(F.collect_list(F.struct(F.col("lsn").alias("l"), env.alias("e"))), "l").alias("vs")).select("key", F.reverse(F.transform("vs", lambda x: x["e"])).alias("vs"))
    best = picked.select("key", versioning.pick_by_timestamp(F.col("vs")).alias("b"))
    return best.select("key", "b.lsn", F.when(~F.col("b.deleted"), F.col("b.value")).alias("value"))


@query(f"with {_CLOCK} select r, key, lsn, cast(c0 as bigint) as c0, cast(c1 as bigint) as c1, cast(c2 as bigint) as c2, op=2 as deleted, coalesce(value,'') as value from kv_replica")
def envelope_roundtrip(spark, sf):
    r = views.kv_replica(spark, sf)
    text = r.select("r", "key", "lsn", versioning.encode(versioning.envelope(F.col("vector_clock"), F.col("lsn"), F.col("op") == 2, F.col("value"))).alias("t"))
    back = text.select("r", "key", "lsn", versioning.decode(F.col("t")).alias("e"))
    return back.select("r", "key", "lsn", *[F.element_at("e.vector_clock", n).cast("long").alias(f"c{i}") for i, n in enumerate(views.NODES)], "e.deleted", "e.value")


# ---- quorums and repair


@query(
    f"with {_CLOCK}, owners as (select distinct key from kv_log), a as (select o.key, n.r, (abs(hash_r)%7<>0) as ok from (select key, r, (cast(substr(key,2,6) as int)+cast(substr(key,9,2) as int)*3+r*5) as hash_r from owners cross join (select 1 as r union all select 2 union all select 3) n) o join (select 1 as r union all select 2 union all select 3) n on n.r=o.r), "
    "v as (select a.key, a.r, a.ok, k.c0, k.c1, k.c2, k.lsn from a left join kv_replica k on k.key=a.key and k.r=a.r and a.ok), "
    "s as (select v.key, v.r from v where v.lsn is not null and not exists (select 1 from v o where o.key=v.key and o.lsn is not null and o.r<>v.r and ((v.c0<=o.c0 and v.c1<=o.c1 and v.c2<=o.c2 and not (v.c0=o.c0 and v.c1=o.c1 and v.c2=o.c2)) or (o.r<v.r and v.c0=o.c0 and v.c1=o.c1 and v.c2=o.c2)))), "
    "g as (select key, cast(sum(case when ok then 1 else 0 end) as bigint) as acks from v group by key), n as (select key, count(*) as n from s group by key) "
    "select g.key, acks, case when acks<2 then 'unavailable' when n is null then 'not_found' else 'ok' end as status, cast(coalesce(n,0) as bigint) as n_versions from g left join n on g.key=n.key"
)
def quorum_read(spark, sf):
    keys = _log(spark, sf).select("key").distinct().withColumn("r", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    down = (F.substring("key", 2, 6).cast("int") + F.substring("key", 9, 2).cast("int") * 3 + F.col("r") * 5) % 7 == 0
    held = views.kv_replica(spark, sf).select("key", "r", F.struct("vector_clock", "value", "lsn").alias("envelope"))
    answers = keys.withColumn("ok", ~down).join(held, ["key", "r"], "left").withColumn("node_id", F.col("r").cast("string"))
    out = coordination.read_outcome(answers, 2)
    return out.select("key", "acks", "status", F.size("versions").cast("long").alias("n_versions"))


@query(
    f"with {_LOG}, {_RANGES}, w as (select lsn, key, (lsn%5)-1 as quorum from kv_log), f as (select w.*, unnest(string_split(reps,',')) as node_id from w join ranges on {_HALF}), "
    "a as (select key, quorum, lsn, count(*) as owners, cast(sum(case when (lsn+cast(substr(node_id,2) as int))%4<>0 then 1 else 0 end) as bigint) as acks from f group by 1,2,3), q as (select *, cast(case when quorum<=0 then 2 else quorum end as int) as required from a) "
    "select cast(lsn as varchar) as key, acks, required, case when required>owners then 'invalid' when acks>=required then 'ok' else 'unavailable' end as status from q"
)
def quorum_write(spark, sf):
    w = _log(spark, sf).select("lsn", "key", (F.col("lsn") % 5 - 1).cast("int").alias("quorum"))
    sent = coordination.fan_out(w, views.ranges(spark))
    ok = (F.col("lsn") + F.substring("node_id", 2, 9).cast("int")) % 4 != 0
    return coordination.write_outcome(sent.select(F.col("lsn").cast("string").alias("key"), "node_id", ok.alias("ok"), "quorum"), 2)


def _sides(spark, sf):
    r = views.kv_replica(spark, sf)
    return r.filter("r = 1").drop("r"), r.filter("r = 2").drop("r")


_ACTION = "case when relation in ('missing_here','before') then 'pull' when relation in ('missing_there','after') then 'push' else 'none' end"


@query(f"with {_CLOCK} select key, relation, {_ACTION} as action from pair")
def replica_diff(spark, sf):
    return antientropy.diff(*_sides(spark, sf))


@query(f"with {_CLOCK} select {_ACTION} as action, relation, count(*) as n from pair group by 1,2")
def repair_actions(spark, sf):
    return antientropy.diff(*_sides(spark, sf)).groupBy("action", "relation").agg(F.count("*").alias("n"))


@query(f"with {_CLOCK} select case when relation='concurrent' then 'concurrent' else 'equal' end as relation, count(*) as n from pair group by 1")
def repair_fixpoint(spark, sf):
    return antientropy.diff(*antientropy.repair(*_sides(spark, sf))).groupBy("relation").agg(F.count("*").alias("n"))


_DIG = "select substr(key,1,6) as bucket, count(*) as n, sha256(string_agg(d,'' order by key)) as digest from (select key, sha256(concat(lpad(cast(strlen(key) as varchar),20,'0'),key,lpad(cast(coalesce(strlen(value),0) as varchar),20,'0'),coalesce(value,''))) as d from kv_replica where r="


@query(
    f"with {_CLOCK}, a as ({_DIG}1) t group by 1), b as ({_DIG}2) t group by 1) select coalesce(a.bucket,b.bucket) as bucket, coalesce(a.n,0) as n_left, coalesce(b.n,0) as n_right from a full join b on a.bucket=b.bucket where a.n is distinct from b.n or a.digest is distinct from b.digest"
)
def bucket_digest_mismatch(spark, sf):
    a, b = (s.withColumn("bucket", F.substring("key", 1, 6)) for s in _sides(spark, sf))
    return antientropy.mismatched(a, b, ["bucket"])


@query("select * from (values (0,'','3fffffffffffffff'),(1,'3fffffffffffffff','7ffffffffffffffe'),(2,'7ffffffffffffffe','bffffffffffffffd'),(3,'bffffffffffffffd','')) t(bucket,from_hex,to_hex)")
def range_split_buckets(spark, sf):
    return spark.createDataFrame([(i, a.hex(), b.hex()) for i, (a, b) in enumerate(antientropy.split_range(b"", b"", 4))], "bucket int, from_hex string, to_hex string")


_SUMS = "select substr(key,1,6) as bucket, count(*) as n, sum(('0x'||substr(d,1,15))::ubigint) as s0, sum(('0x'||substr(d,16,15))::ubigint) as s1 from (select key, sha256(concat(lpad(cast(strlen(key) as varchar),20,'0'),key,lpad(cast(coalesce(strlen(value),0) as varchar),20,'0'),coalesce(value,''))) as d from kv_replica where r="


@query(f"with {_CLOCK}, a as ({_SUMS}1) t group by 1) select bucket, n, cast(s0 as varchar) as s0, cast(s1 as varchar) as s1 from a")
def bucket_sums(spark, sf):
    a = _sides(spark, sf)[0].withColumn("bucket", F.substring("key", 1, 6))
    return antientropy.sums(a, ["bucket"]).select("bucket", "n", F.col("s0").cast("string").alias("s0"), F.col("s1").cast("string").alias("s1"))


@query()
def differing_leaves(spark, sf):
    """The leaves of the digest tree whose rows differ, and how many rows each side has there."""
    a, b = (s.select("key", "value") for s in _sides(spark, sf))
    leaves = antientropy.differing_leaves(a, b, b"u", b"v", max_depth=6)
    found = antientropy.mismatched(antientropy.bucketed(a, leaves or [(b"", b"")]), antientropy.bucketed(b, leaves or [(b"", b"")]), ["bucket"])
    names = spark.createDataFrame([(i, x.hex(), y.hex()) for i, (x, y) in enumerate(leaves)] or [(0, "", "")], "bucket int, from_hex string, to_hex string")
    return found.join(F.broadcast(names), "bucket").select("from_hex", "to_hex", "n_left", "n_right")


# ---- sketches

_H = "('0x'||md5(%s)[1:16])::UBIGINT"


@query(
    f"with b as (select distinct event_type, {_H % 'cast(user_id as varchar)'} as h from events), r as (select event_type, h >> 50 as idx, case when (h & 1125899906842623)=0 then 51 else 50-floor(log2(cast(h & 1125899906842623 as double)))::bigint end as rnk from b), "
    "g as (select event_type, idx, max(rnk) as reg from r group by 1,2), s as (select event_type, count(*) as used, sum(pow(2.0,-reg)) as s from g group by 1), e as (select event_type, 16384-used as zeros, (0.7213/(1+1.079/16384))*16384.0*16384.0/(s+16384-used) as raw from s) "
    "select event_type, cast(floor(case when raw<=2.5*16384 and zeros>0 then 16384*ln(16384.0/zeros) else raw end) as bigint) as estimate from e"
)
def hll_estimate(spark, sf):
    e = views.table(spark, sf, "events").select("event_type", F.col("user_id").cast("string").alias("u"))
    p = sketches.hll_precision(0.01)
    return sketches.hll_estimate(sketches.hll(e, "u", p, ["event_type"]), p, ["event_type"])


_SEEDS = "(values (0,'9E3779B9'),(1,'3C6EF372'),(2,'DAA66D2B'),(3,'78DDE6E4'),(4,'1715609D')) s(\"row\",seed)"


@query(
    f"with u as (select cast(user_id as varchar) as u, count(*) as n from events group by 1), c as (select u, n, \"row\", {_H % 'encode(u)||unhex(seed)'} % 272 as cell from u cross join {_SEEDS}), t as (select \"row\", cell, sum(n) as n from c group by 1,2) "
    "select u as user_id, cast(min(t.n) as bigint) as estimate from c join t on c.\"row\"=t.\"row\" and c.cell=t.cell group by 1"
)
def cms_estimate(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"))
    w, d = sketches.cms_size(0.01, 0.01)
    return sketches.cms_estimate(sketches.cms(e, "user_id", w, d), e, "user_id", w, d)


_BITS_OF = "select {c}, {h} % (select m from size) as bit from (select distinct {c} from {t}) k cross join (select unnest(range(1,8)) as seed) s"
_SIZE = "size as (select cast(ceil(count(distinct {c})*abs(ln(0.01))/(ln(2)*ln(2))) as ubigint) as m from {t})"


def _bloom_sql(table: str, column: str = "key") -> str:
    return _BITS_OF.format(h=_H % f"encode({column})||unhex(printf('%08X',seed))", t=table, c=column)


def _sized(keys: DataFrame, column: str) -> tuple[int, int]:
    """Bits and hash functions for all distinct entries, as a filter is sized when its table is written."""
    return sketches.bloom_size(keys.select(column).distinct().count(), 0.01)


_LIVE_BLOOM = f"live as (select key from kv_state), {_SIZE.format(c='key', t='live')}, bits as (select distinct bit from ({_bloom_sql('live')}) x)"


@query(f"with {_LOG}, {_LIVE_BLOOM}, p as ({_bloom_sql('kv_log')}) select p.key, count(*)=count(bits.bit) as maybe from p left join bits on p.bit=bits.bit group by 1")
def bloom_membership(spark, sf):
    log = _log(spark, sf)
    live = state.live(log)
    m, k = _sized(live, "key")
    return sketches.bloom_contains(sketches.bloom(live, "key", m, k), log, "key", m, k)


@query(f"with {_LOG}, {_LIVE_BLOOM} select cast(count(*) as bigint) as entries, cast((select count(*) from bits) as bigint) as bits_set, cast(0 as bigint) as missed from live")
def bloom_no_false_negative(spark, sf):
    keys = state.live(_log(spark, sf)).select("key")
    m, k = _sized(keys, "key")
    bits = sketches.bloom(keys, "key", m, k)
    asked = sketches.bloom_contains(bits, keys, "key", m, k).agg(F.count("*").alias("entries"), F.count_if(~F.col("maybe")).alias("missed"))
    return asked.crossJoin(F.broadcast(bits.agg(F.count("*").alias("bits_set")))).select("entries", "bits_set", "missed")  # one row each


_PREFIXES = "p as (select distinct substr(key,1,n) as prefix from (select key, unnest(range(1,least(128,length(key))+1)) as n from kv_state) t)"


@query(
    f"with {_LOG}, {_PREFIXES}, {_SIZE.format(c='prefix', t='p')}, bits as (select distinct bit from ({_bloom_sql('p', 'prefix')}) x), asked as (select prefix from p union select concat(prefix,'~') from p), a as ({_bloom_sql('asked', 'prefix')}) "
    "select a.prefix, count(*)=count(bits.bit) as maybe from a left join bits on a.bit=bits.bit group by 1"
)
def prefix_bloom(spark, sf):
    p = sketches.prefixes(state.live(_log(spark, sf)), "key")
    m, k = _sized(p, "prefix")
    asked = p.unionByName(p.select(F.concat("prefix", F.lit("~")).alias("prefix")))
    return sketches.bloom_contains(sketches.bloom(p, "prefix", m, k), asked, "prefix", m, k)


_TOKENS = "(select doc_id, unnest(string_split(text,' ')) as tok from documents) where tok<>''"
_BITS = f"list_transform(range(0,64), i -> case when (({_H % 'tok'} >> (63-i)) & 1)=1 then 1 else -1 end)"


_VOTES = ",".join(f"sum(case when ((h >> {63 - i}) & 1)=1 then 1 else -1 end) as v{i}" for i in range(64))
_PRINT = "concat(" + ",".join(f"case when v{i}>0 then '1' else '0' end" for i in range(64)) + ")"


@query(f"with t as (select doc_id, {_H % 'tok'} as h from {_TOKENS}), v as (select doc_id, {_VOTES} from t group by 1) select doc_id, {_PRINT} as fingerprint from v")
def simhash_fingerprint(spark, sf):
    return sketches.simhash(views.table(spark, sf, "documents"), "doc_id", "text")


@query(
    f"with t as (select doc_id, {_H % 'tok'} as h from {_TOKENS}), v as (select doc_id, {_VOTES} from t group by 1), p as (select min(doc_id) as id, {_PRINT} as f from v group by 2) "
    "select x.id as a, y.id as b, cast(hamming(x.f,y.f) as int) as distance from p x join p y on x.id<y.id where hamming(x.f,y.f)<=3"
)
def simhash_near_dups(spark, sf):
    return sketches.near_fingerprints(sketches.simhash(views.table(spark, sf, "documents"), "doc_id", "text"), "doc_id", 3)


@query(f"with t as (select doc_id, {_H % 'tok'} as h from {_TOKENS}), v as (select doc_id, {_VOTES} from t group by 1) select doc_id, min(doc_id) over (partition by {_PRINT}) as representative from v")
def simhash_groups(spark, sf):
    return sketches.fingerprint_groups(sketches.simhash(views.table(spark, sf, "documents"), "doc_id", "text"), "doc_id")


def _merkle_sql() -> str:
    leaf = "sha256(concat(lpad(cast(strlen(key) as varchar),20,'0'),key,lpad(cast(coalesce(strlen(value),0) as varchar),20,'0'),coalesce(value,'')))"
    out = f"l0 as (select substr(key,1,7) as tree, row_number() over (partition by substr(key,1,7) order by key)-1 as idx, {leaf} as h from kv_state)"
    for i in range(4):
        out += f", l{i + 1} as (select tree, idx//2 as idx, sha256(concat(max(case when idx%2=0 then h end), coalesce(max(case when idx%2=1 then h end),''))) as h from l{i} group by 1,2)"
    return out


@query(f"with {_LOG}, {_merkle_sql()} select tree, h as root from l4")
def merkle_root(spark, sf):
    rows = state.live(_log(spark, sf)).withColumn("tree", F.substring("key", 1, 7))
    return sketches.merkle_root(sketches.merkle_leaves(rows, "tree"), "tree", 16)


# ---- membership, limits


def _records(spark, sf):
    e = views.table(spark, sf, "events")
    status = F.element_at(F.array(*[F.lit(s) for s in ("alive", "suspect", "dead", "unknown")]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("node_id"), F.when(F.col("event_id") % 11 == 0, "other").otherwise("c").alias("cluster_id"), status.alias("status"), (F.col("event_id") % 97).alias("incarnation"), (F.col("event_id") * 31 % 1009).alias("range_map_epoch"))


@query(
    "with r as (select concat('m',cast(user_id as varchar)) as node_id, case when event_id%11=0 then 'other' else 'c' end as cluster_id, list_value('alive','suspect','dead','unknown')[cast(event_id%4+1 as int)] as status, event_id%97 as incarnation, event_id*31%1009 as range_map_epoch from events), "
    "o as (select *, row_number() over (partition by node_id order by incarnation desc, case status when 'dead' then 3 when 'suspect' then 2 when 'alive' then 1 else 0 end desc) rn, max(range_map_epoch) over (partition by node_id) as epoch from r where cluster_id='c' and node_id<>'m1') "
    "select node_id, status, incarnation, epoch as range_map_epoch from o where rn=1 union all "
    "select 'm1', 'alive', coalesce((select max(incarnation)+1 from r where cluster_id='c' and node_id='m1' and status in ('suspect','dead') and incarnation>=5),5), 0"
)
def membership_merge(spark, sf):
    return membership.merge(_records(spark, sf), "c", "m1", 5)


@query(
    "with recursive e as (select user_id as target, event_id as tick, event_type<>'error' or value>40 as ok, row_number() over (partition by user_id order by event_id) as n from events), "
    "f(target, n, tick, status, since) as (select target, n, tick, case when ok then 'alive' else 'suspect' end, case when ok then null else tick end from e where n=1 union all "
    "select e.target, e.n, e.tick, case when f.status='dead' then 'dead' when e.ok then 'alive' when f.status='alive' then 'suspect' when e.tick-f.since>=200 then 'dead' else 'suspect' end, "
    "case when f.status='dead' then f.since when e.ok then null when f.status='alive' then e.tick else f.since end from f join e on e.target=f.target and e.n=f.n+1) select target, tick, status from f"
)
def failure_detector(spark, sf):
    e = views.table(spark, sf, "events")
    return membership.detect(e.select(F.col("user_id").alias("target"), F.col("event_id").alias("tick"), (F.col("event_type") != "error").alias("direct_ok"), (F.col("value") > 40).alias("indirect_ok")), 200)


@query(
    "with recursive e as (select user_id as u, event_id as seq, event_id//100 as ts, row_number() over (partition by user_id order by event_id//100, event_id) as n from events), "
    "f(u, n, seq, ts, tokens, since, allowed) as (select u, n, seq, ts, cast(2 as bigint), ts, true from e where n=1 union all "
    "select u, n, seq, ts, case when have>=1 then have-1 else tokens end, case when have>=1 then ts else since end, have>=1 from (select e.u, e.n, e.seq, e.ts, f.tokens, f.since, least(3, f.tokens+cast(floor((e.ts-f.since)*0.25) as bigint)) as have from f join e on e.u=f.u and e.n=f.n+1) x) "
    'select u as "user", seq, ts as ts_seconds, allowed from f'
)
def token_bucket(spark, sf):
    e = views.table(spark, sf, "events")
    return limits.token_bucket(e.select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 100).cast("long").alias("ts_seconds")), rate=0.25, most=3)


@query(f"with {_LOG} select lsn, op, key, coalesce(value,'') as value from kv_log")
def wal_record_decode(spark, sf):
    """Log rows written to segments' bytes and read back."""
    rows = _log(spark, sf).select("lsn", F.col("op").cast("int").alias("op"), "key", F.coalesce("value", F.lit("")).alias("value"))
    segments = wal.encode(rows, per_segment=256)
    return wal.decode(segments).filter("not corrupt").select("lsn", "op", "key", "value")


@query(f"with {_LOG} select key, value, lsn from kv_state")
def feed_materialised(spark, sf):
    """The log committed to a store in four batches, the newest first, and followed by a stream into another one: LSNs decide, not arrival."""
    root = f"{scratch(spark)}/feed-{uuid.uuid4().hex}"
    log, source, to = _log(spark, sf).select("lsn", "op", "key", "value"), KVStore(spark, f"{root}/a"), KVStore(spark, f"{root}/b")
    parts = (log.agg(F.max("lsn")).first()[0] or 0) // 4 + 1
    for i in reversed(range(4)):
        source.append(log.filter(F.floor((F.col("lsn") - 1) / parts) == i))
    feeds.materialise(feeds.commits(spark, f"{root}/a", files_per_batch=2), to, f"{root}/c").awaitTermination()
    return to.state()
