"""Vector clocks as maps (a missing node counts 0), envelopes, and reconciliation of versions, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvarn.schema import ENVELOPE

MAGIC = "KVENV1:"


def _at(clock: Column, node: Column) -> Column:
    return F.coalesce(F.try_element_at(clock, node), F.lit(0))


def covered(a: Column, b: Column) -> Column:
    """a <= b: no counter of a is higher.

    The two directions are written with different functions on purpose: the optimizer takes expressions that differ only in
    which lambda variables they name for equal, and would simplify ``x & ~y`` of them to false.
    """
    return F.forall(F.map_keys(a), lambda k: _at(a, k) <= _at(b, k))


def exceeds(b: Column, a: Column) -> Column:
    """Some counter of b is higher than in a."""
    return F.exists(F.map_keys(b), lambda k: _at(b, k) > _at(a, k))


def before(a: Column, b: Column) -> Column:
    return covered(a, b) & exceeds(b, a)


def same(a: Column, b: Column) -> Column:
    return covered(a, b) & ~exceeds(b, a)


def compare(a: Column, b: Column) -> Column:
    """equal, before, after or concurrent."""
    more = exceeds(b, a)
    return F.when(covered(a, b), F.when(more, "before").otherwise("equal")).otherwise(F.when(more, "concurrent").otherwise("after"))


def merge(a: Column, b: Column) -> Column:
    zero = lambda x: F.coalesce(x, F.lit(0))
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(zero(x), zero(y)))


def merge_all(clocks: Column) -> Column:
    """Elementwise maximum of an array of clocks."""
    nodes = F.array_sort(F.array_distinct(F.flatten(F.transform(clocks, F.map_keys))))
    return F.map_from_arrays(nodes, F.transform(nodes, lambda n: F.array_max(F.transform(clocks, lambda c: _at(c, n)))))


def increment(clock: Column, node: Column | str) -> Column:
    node = F.lit(node) if isinstance(node, str) else node
    others = F.map_filter(clock, lambda k, _: k != node)
    return F.map_concat(others, F.create_map(node, (_at(clock, node) + 1).cast("decimal(20,0)")))


def in_order(items: Column, by: str) -> Column:
    """An array of structs by one of their fields; maps among the others cannot be compared."""
    return F.array_sort(items, lambda a, b: F.when(a[by] < b[by], -1).when(a[by] > b[by], 1).otherwise(0))


def canonical(clock: Column) -> Column:
    """Entries above 0 in the order of their nodes, as text."""
    held = F.array_sort(F.map_entries(F.map_filter(clock, lambda _, v: v > 0)))
    return F.array_join(F.transform(held, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def reconcile(versions: Column, clock: str = "vector_clock") -> Column:
    """The versions that no other one dominates, in their order; of equal clocks the first. One left: a winner; more: siblings."""
    numbered = F.transform(versions, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    beaten = lambda c, o: before(c["v"][clock], o["v"][clock]) | ((o["i"] < c["i"]) & same(c["v"][clock], o["v"][clock]))
    return F.transform(F.filter(numbered, lambda c: ~F.exists(numbered, lambda o: beaten(c, o))), lambda x: x["v"])


def pick_by_timestamp(versions: Column) -> Column:
    """The newest version; ties: a delete, then the larger value, then the larger clock text."""
    key = lambda v: F.struct(v["updated_at_unix_nano"], v["deleted"], F.coalesce(v["value"], F.lit("")), canonical(v["vector_clock"]))
    return F.reduce(F.slice(versions, 2, 1 << 30), F.get(versions, F.lit(0)), lambda a, v: F.when(key(v) > key(a), v).otherwise(a))


def envelope(clock: Column, nanos: Column, deleted: Column, value: Column) -> Column:
    """A normalised envelope: a delete has the empty value."""
    return F.struct(
        F.lit(1).alias("version"),
        clock.cast("map<string,decimal(20,0)>").alias("vector_clock"),
        nanos.cast("long").alias("updated_at_unix_nano"),
        deleted.alias("deleted"),
        F.when(deleted, F.lit("")).otherwise(F.coalesce(value, F.lit(""))).alias("value"),
    )


def encode(env: Column) -> Column:
    """Magic and JSON; clock entries by node."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(env["vector_clock"])))
    return F.concat(F.lit(MAGIC), F.to_json(env.withField("vector_clock", ordered)))


def is_encoded(text: Column) -> Column:
    return text.startswith(MAGIC)


def decode(text: Column) -> Column:
    """The envelope, or null if the text has no magic, another version, or no time."""
    got = F.from_json(F.substring(text, len(MAGIC) + 1, 1 << 30), ENVELOPE)
    return F.when(is_encoded(text) & (got["version"] == 1) & (got["updated_at_unix_nano"] != 0), got)


def from_entries(entries: Column) -> Column:
    """A clock of (node, counter) entries as they are sent: those with an empty node id are left out; of a node sent twice the highest counts."""
    held = F.filter(entries, lambda e: e["node"].isNotNull() & (e["node"] != ""))
    nodes = F.array_sort(F.array_distinct(F.transform(held, lambda e: e["node"])))
    return F.map_from_arrays(nodes, F.transform(nodes, lambda n: F.array_max(F.transform(F.filter(held, lambda e: e["node"] == n), lambda e: e["counter"].cast("decimal(20,0)")))))


def to_entries(clock: Column) -> Column:
    """(node, counter) entries in the order of their nodes, without empty node ids."""
    return F.transform(F.array_sort(F.filter(F.map_entries(clock), lambda e: e["key"] != "")), lambda e: F.struct(e["key"].alias("node"), e["value"].alias("counter")))
