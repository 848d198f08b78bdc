"""Exact n-gram Jaccard join: tries of globally ordered n-gram sets, traversed with shared partial overlaps.

A document's set holds the 64-bit hashes of its distinct word n-grams. Equal sets are one node of the join.

*Which sets meet.* All n-grams are put in one global order: from rare to frequent by the number of sets that hold them,
ties by hash. Of two sets with a Jaccard similarity of at least p, each holds at least t = ceil(p * size) elements of the
other, so they share one of their first size - t + 1 elements (the prefix). A set whose elements are shared with others
in fewer than t places can be linked with nothing and is left out; the others send the shared elements of their prefix.
Since the prefix holds the rarest n-grams, sets do not meet over a passage that many hold. A key also carries a band of
sizes, as sets of very different sizes cannot be similar.

*How they are joined.* The sets that meet, directly or through others, form groups; each group is stored in a
path-compressed trie, in the order of the hash. A set is run down the trie, and the overlap with a path is counted once
for all sets below it. A subtree is left when even all remaining elements could not reach the overlap its lengths ask
for, or when its sets are all known to be in the same component already. A group above ``GROUP_SHINGLES`` is dealt into
blocks that share a few landmark sets. Only sets that are then not linked to the largest component of the group are
run down the tries of its other blocks, so a large group of copies is read once.

*Flow.* Input blocks (a few thousand texts) are written once as word numbers of their distinct sets. N-grams and keys
travel in packed arrays, one for each block and bucket, and a key shared within a block is sent once, so a hot n-gram, set or key is
one entry a block. Sets meet by a few of their keys first; then all keys are sent for the groups so found, so that copies do not
meet again under each of their keys. No text is shuffled.

Null or empty texts have an empty set, link with nothing and are their own component. A text with fewer than ``n``
words has one element, its whole sequence. Rows with equal doc_id are joined by their own texts; a null doc_id
takes the smallest doc_id of its component, or null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, components, discard, from_six, materialise, pack_numbers, release, six_bytes, trim, unpack_numbers

GROUP_SHINGLES = 2_000_000
BUCKET_SHINGLES = 2_000_000
BUNDLE_BYTES = 16_000_000
BLOCK_DOCS, BLOCK_BYTES = 4000, 6_000_000
LANDMARKS, FEW_KEYS = 8, 4
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chained(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    acc = h[: len(h) - k + 1] * _P1 + np.uint64(k)
    for j in range(1, k):
        acc = mix(acc) * _P2 + h[j : len(h) - k + 1 + j]
    return mix(acc)


def sets_of(hashes: np.ndarray, sizes: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-grams of texts of ``sizes`` words whose words' hashes stand one after another."""
    every = _chained(hashes, n) if len(hashes) >= n else hashes[:0]
    found, at = [], 0
    for size in sizes.tolist():
        own = np.sort(every[at : at + size - n + 1]) if size >= n else _chained(hashes[at : at + size], size) if size else hashes[:0]
        found.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
        at += size
    return found


def words_of(text: str | None) -> list[bytes]:
    """The words, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text."""
    own = words_of(text)
    return sets_of(np.array([xxhash.xxh3_64_intdigest(w) for w in own], dtype=np.uint64), np.array([len(own)]), n)[0]


def row_hash(text: str | None) -> int:
    """What Spark's ``xxhash64`` gives for the text."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def band_edges(percent: int, top: int = 1 << 40) -> np.ndarray:
    """First sizes of the bands: sets that may be similar are in the same or in neighbouring ones."""
    edges = [1]
    while edges[-1] < top:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * 100 // percent + 1))
    return np.array(edges, dtype=np.int64)


class _Node:
    __slots__ = ("hi", "ids", "kids", "leaf", "lo", "segment", "stop", "uniform")

    def __init__(self, segment: np.ndarray, stop: int, lo: int, hi: int):
        self.segment, self.stop, self.lo, self.hi = segment, stop, lo, hi
        self.kids: list[_Node] = []
        self.leaf, self.uniform = -1, -1


def _common(a: np.ndarray, b: np.ndarray, start: int) -> int:
    n = min(len(a), len(b))
    other = np.flatnonzero(a[start:n] != b[start:n])
    return start + int(other[0]) if len(other) else n


def build_trie(sets: list[np.ndarray], order: list[int]) -> tuple[_Node, list[_Node]]:
    """A path-compressed trie of distinct sets; ``order`` lists them lexicographically. All nodes, parents first, come along."""
    root = _Node(np.zeros(0, dtype=np.uint64), 0, min(len(sets[i]) for i in order), max(len(sets[i]) for i in order))
    nodes, todo = [root], [(root, 0, len(order))]
    while todo:
        node, a, b = todo.pop()
        if a < b and len(sets[order[a]]) == node.stop:
            node.leaf = order[a]
            a += 1
        while a < b:
            token, e = sets[order[a]][node.stop], a + 1
            while e < b and sets[order[e]][node.stop] == token:
                e += 1
            stop = len(sets[order[a]]) if e == a + 1 else _common(sets[order[a]], sets[order[e - 1]], node.stop)
            sizes = [len(sets[order[i]]) for i in range(a, e)]
            kid = _Node(sets[order[a]][node.stop : stop], stop, min(sizes), max(sizes))
            node.kids.append(kid)
            nodes.append(kid)
            todo.append((kid, a, e))
            a = e
    return root, nodes


def trie_components(sets: list[np.ndarray], percent: int, probes: list[int] | None = None, stored: list[int] | None = None) -> list[int]:
    """The least index that each set is linked to, directly or through others. With ``probes`` and ``stored``, only sets of the one against sets of the other."""
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    stored = list(range(len(sets))) if stored is None else stored
    probes = stored if probes is None else probes
    if not stored or not probes:
        return parent
    root, nodes = build_trie(sets, sorted(stored, key=lambda i: sets[i].astype(">u8").tobytes()))
    unions, fresh = 0, 0

    def refresh() -> None:
        for node in reversed(nodes):
            own = {find(node.leaf)} if node.leaf >= 0 else set()
            own |= {kid.uniform for kid in node.kids}
            node.uniform = own.pop() if len(own) == 1 else -1

    for turn, i in enumerate(probes):
        if unions > fresh and (turn & (turn - 1) == 0 or turn % 64 == 0):
            refresh()
            fresh = unions
        s, a = sets[i], len(sets[i])
        least, most = -(-percent * a // 100), 100 * a // percent
        todo = [(root, 0, 0)]
        while todo:
            node, overlap, at = todo.pop()
            if node.hi < least or node.lo > most or (fresh and node.uniform >= 0 and find(node.uniform) == find(i)):
                continue
            if len(node.segment):
                where = np.searchsorted(s, node.segment)
                inside = where < a
                overlap += int((s[where[inside]] == node.segment[inside]).sum())
                at = int(np.searchsorted(s, node.segment[-1], side="right"))
            need = -(-percent * (a + max(node.lo, least)) // (100 + percent))
            if overlap + min(a - at, node.hi - node.stop) < need:
                continue
            if node.leaf >= 0 and node.leaf != i and (100 + percent) * overlap >= percent * (a + node.stop):
                x, y = find(i), find(node.leaf)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    unions += 1
            todo.extend((kid, overlap, at) for kid in node.kids)
    return [find(i) for i in range(len(sets))]


_CODED = "block long, ids array<long>, rows binary, number binary, sizes binary, tokens binary, words binary, sigs binary, counts binary"


def _coded(docs: DataFrame, n: int) -> DataFrame:
    """A row for each block of documents: their ids and row hashes, the number of each one's set (0: none, else from 1), and for each
    distinct set its words as numbers, its signature and its size; the block's words as hashes."""

    def code(block: int, ids: list, texts: list) -> pa.RecordBatch:
        seen: dict[bytes, int] = {}
        place, kept, count = [], [], {}
        for text in texts:
            own = words_of(text)
            at = seen.setdefault(xxhash.xxh3_128_digest(b" ".join(own)), len(kept) + 1) if own else 0
            place.append(at)
            if at > len(kept):
                kept.append(own)
                for w in own:
                    count[w] = count.get(w, 0) + 1
        order = sorted(count, key=count.get, reverse=True)  # frequent words get short numbers
        number = {w: k for k, w in enumerate(order)}
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in order], dtype=np.uint64)
        sizes = np.array([len(own) for own in kept], dtype=np.int64)
        tokens = np.array([number[w] for own in kept for w in own], dtype=np.int64)
        sets = sets_of(hashes[tokens] if len(tokens) else hashes, sizes, n)
        first: dict[bytes, int] = {}
        to, chosen = [0], []
        for k, items in enumerate(sets):  # other word sequences may have the same set
            sig = xxhash.xxh3_128_digest(items.tobytes())
            if sig not in first:
                first[sig] = len(first) + 1
                chosen.append(k)
            to.append(first[sig])
        picked = np.zeros(len(kept), dtype=bool)
        picked[chosen] = True
        data = [
            np.array([row_hash(t) for t in texts], "<i8").tobytes(), pack_numbers(np.array(to, dtype=np.int64)[place]), pack_numbers(sizes[picked]),
            pack_numbers(tokens[np.repeat(picked, sizes)]), hashes.tobytes(), b"".join(first), pack_numbers(np.array([len(sets[k]) for k in chosen], dtype=np.int64)),
        ]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in data]], names=[x.split()[0] for x in _CODED.split(", ")])

    def run(batches):
        part, turn = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            size = np.cumsum(np.array([x or 0 for x in pc.binary_length(texts).to_pylist()], dtype=np.int64))
            at = 0
            while at < len(ids):
                to = min(len(ids), at + BLOCK_DOCS, max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, side="right"))))
                yield code((part << 40) | (turn << 20), ids[at:to], texts.slice(at, to - at).to_pylist())
                turn, at = turn + 1, to
                trim()

    return docs.mapInArrow(run, _CODED)


_SETS = ["block", "sizes", "tokens", "words"]


def _rebuilt(sizes: bytes, tokens: bytes, words: bytes, n: int) -> list[np.ndarray]:
    """The distinct sets of a block."""
    if not sizes:
        return []
    return sets_of(np.frombuffer(words, "<u8")[unpack_numbers(tokens)], unpack_numbers(sizes), n)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the upper half of the hash: sorted keys have sorted buckets."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _table(columns_: list, names: list[str], kinds: list) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(columns_, kinds, strict=True)], names=names)


def _counted(coded: DataFrame, n: int, buckets: int) -> DataFrame:
    """(block, bucket, df): for a block's distinct n-grams in a bucket, in their order, how many sets of all blocks hold them."""

    def send(batches):
        for batch in batches:
            for block, *data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                sets = _rebuilt(*data, n)
                if not sets:
                    continue
                keys, count = np.unique(np.concatenate(sets), return_counts=True)
                cuts = np.searchsorted(_bucket_of(keys, buckets), np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts)).tolist()
                low = (keys & _LOW).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array([low[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()), pa.array([pack_numbers(count[cuts[b] : cuts[b + 1]]) for b in full], pa.binary())],
                    names=["bucket", "block", "keys", "counts"],
                )
                del sets, keys, count
                trim()

    def total(table: pa.Table) -> pa.Table:
        # the lower halves of two hashes may agree: both then count for both, which brings sets together that need not meet
        rows = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
        names, back = np.unique(np.concatenate(rows), return_inverse=True)
        df = np.bincount(back, weights=np.concatenate([unpack_numbers(x) for x in table.column("counts").to_pylist()]), minlength=len(names)).astype(np.int64)[back]
        cuts = np.cumsum([0, *map(len, rows)])
        found = [pack_numbers(df[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "df": pa.array(found, pa.binary())})

    sent = coded.select(*_SETS).mapInArrow(send, "bucket int, block long, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(total, "block long, bucket int, df binary")


def prefix_keys(sets: list[np.ndarray], df: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places of their sets): for the own and the next band of sizes, the shared elements of each set's prefix."""
    edges, keys, who = band_edges(percent), [], []
    for i, (items, d) in enumerate(zip(sets, df, strict=True)):
        size, shared = len(items), d > 1
        least = -(-percent * size // 100)
        if int(shared.sum()) < least:
            continue
        alone, room = size - int(shared.sum()), size - least + 1
        some, d = items[shared], d[shared]
        chosen = some[np.lexsort((some, d))[: room - alone]]
        band = int(np.searchsorted(edges, size, side="right")) - 1
        keys += [mix(chosen + np.uint64(b) * _P1) for b in (band, band + 1)]
        who.append(np.full(2 * len(chosen), i, dtype=np.int64))
    return (np.concatenate(keys), np.concatenate(who)) if keys else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


def forest(k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the nodes ``v`` that have a key ``k`` in common: a star for each component, its least node in the middle."""
    order = np.argsort(k, kind="stable")
    k, v = k[order], v[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(start, len(k)))
    v, group = v[np.repeat(size > 1, size)], np.repeat(np.arange((size > 1).sum()), size[size > 1])
    names, node = np.unique(v, return_inverse=True)
    label = np.arange(len(names))
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else group
    while len(names):
        least = np.minimum.reduceat(label[node], first)
        new = label.copy()
        np.minimum.at(new, node, least[group])
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(names))
    return names[label[other]], names[other]


_EDGES = ["bucket", "block", "keys", "who", "a", "b"]
_EDGE_KINDS = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


def _few(keys: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Places of the FEW_KEYS least keys of each set."""
    order = np.lexsort((keys, who))
    start = np.flatnonzero(np.concatenate([[True], who[order][1:] != who[order][:-1]])) if len(who) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return np.sort(order[rank < FEW_KEYS])


def _cuts(keys: np.ndarray, buckets: int) -> tuple[list[int], np.ndarray]:
    """Buckets that sorted keys go to, and where each begins."""
    cuts = np.searchsorted(_bucket_of(keys, buckets), np.arange(buckets + 1))
    return np.flatnonzero(np.diff(cuts)).tolist(), cuts


def _met(coded: DataFrame, counted: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """(node, root) of the sets (a block's number plus the set's) that meet others: by a few keys of each set first, then by all keys of the groups so found."""

    def meet_within(left: pa.Table, right: pa.Table) -> pa.Table:
        """Edges of sets that share a key in the block; the block's keys with a set that has each; the least keys of each set by bucket."""
        if not left.num_rows or not right.num_rows:
            return _table([[]] * 6, _EDGES, _EDGE_KINDS)
        block, *data = (left.column(c)[0].as_py() for c in _SETS)
        sets = _rebuilt(*data, n)
        buckets_, answers = right.column("bucket").to_pylist(), right.column("df").to_pylist()
        df = np.concatenate([unpack_numbers(answers[i]) for i in np.argsort(buckets_)])
        back = np.unique(np.concatenate(sets), return_inverse=True)[1]
        each = np.split(df[back], np.cumsum([len(s) for s in sets])[:-1])
        keys, who = prefix_keys(sets, each, percent)
        a, b = forest(keys, who + 1 + block)
        few = np.unique(keys[_few(keys, who)])
        keys, first = np.unique(keys, return_index=True)  # a key is sent once for the block
        who = who[first] + 1
        at = np.searchsorted(keys, few)
        full, cuts = _cuts(few, buckets)
        m, e = len(full), len(a)
        out = [
            [*full, -1, *[None] * e], [block] * (m + 1 + e), [*[six_bytes(few[cuts[x] : cuts[x + 1]]) for x in full], keys.astype("<u8").tobytes(), *[None] * e],
            [*[pack_numbers(who[at[cuts[x] : cuts[x + 1]]]) for x in full], pack_numbers(who), *[None] * e], [*[None] * (m + 1), *a.tolist()], [*[None] * (m + 1), *b.tolist()],
        ]
        trim()
        return _table(out, _EDGES, _EDGE_KINDS)

    def meet_between(table: pa.Table) -> pa.Table:
        k = np.concatenate([from_six(x) for x in table.column("keys").to_pylist()])
        v = np.concatenate([unpack_numbers(w) + b for w, b in zip(table.column("who").to_pylist(), table.column("block").to_pylist(), strict=True)])
        a, b = forest(k, v)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def relabel(left: pa.Table, right: pa.Table) -> pa.Table:
        """All keys of a block by bucket, each with the group of the set that has it."""
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        if not left.num_rows:
            return _table([[]] * 4, ["bucket", "keys", "roots", "who"], kinds)
        block, keys, who = left.column("block")[0].as_py(), np.frombuffer(left.column("keys")[0].as_py(), "<u8"), unpack_numbers(left.column("who")[0].as_py())
        root = np.arange(int(who.max()) + 1 if len(who) else 0) + block
        if right.num_rows:
            node = right.column("node").to_numpy() - block
            inside = node < len(root)
            root[node[inside]] = right.column("root").to_numpy()[inside]
        full, cuts = _cuts(keys, buckets)
        out = []
        for x in full:
            names, at = np.unique(root[who[cuts[x] : cuts[x + 1]]], return_inverse=True)
            out.append((x, six_bytes(keys[cuts[x] : cuts[x + 1]]), names.astype("<i8").tobytes(), pack_numbers(at)))
        trim()
        return _table(list(zip(*out, strict=True)) or [[]] * 4, ["bucket", "keys", "roots", "who"], kinds)

    def meet_groups(table: pa.Table) -> pa.Table:
        k = np.concatenate([from_six(x) for x in table.column("keys").to_pylist()])
        v = np.concatenate([np.frombuffer(r, "<i8")[unpack_numbers(w)] for r, w in zip(table.column("roots").to_pylist(), table.column("who").to_pylist(), strict=True)])
        a, b = forest(k, v)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    schema = "bucket int, block long, keys binary, who binary, a long, b long"
    within = materialise(coded.select(*_SETS).groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(meet_within, schema), "within")
    discard(counted)
    release(coded.sparkSession)
    between = within.filter("bucket >= 0").select("bucket", "block", "keys", "who").groupBy("bucket").applyInArrow(meet_between, "a long, b long")
    label = materialise(components(within.filter("bucket is null").select("a", "b").unionByName(between).distinct()), "label")
    every = within.filter("bucket = -1").select("block", "keys", "who").groupBy("block")
    sent = every.cogroup(label.withColumn("block", _block_of("node")).groupBy("block")).applyInArrow(relabel, "bucket int, keys binary, roots binary, who binary")
    groups = components(sent.groupBy("bucket").applyInArrow(meet_groups, "a long, b long").distinct())
    wider = groups.select(F.col("node").alias("_own"), F.col("root").alias("_wider"))
    # a group's root that is in no edge of sets is a set that the first step has not met
    alone = groups.join(label.select("node"), "node", "left_anti")
    merged = label.join(wider, label["root"] == wider["_own"], "left").select("node", F.coalesce("_wider", "root").alias("root"))
    found = materialise(merged.unionByName(alone.select("node", "root")), "met")
    discard(within)
    return found


def _block_of(node: str):
    return F.shiftleft(F.shiftright(node, 20), 20)


def _of_groups(coded: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(root, node, items) of the wanted (block, node, root) sets."""
    kinds = [pa.int64(), pa.int64(), pa.binary()]

    def rebuild(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([[]] * 3, ["root", "node", "items"], kinds)
        block, *data = (left.column(c)[0].as_py() for c in _SETS)
        sets, nodes = _rebuilt(*data, n), right.column("node").to_pylist()
        out = _table([right.column("root").to_pylist(), nodes, [sets[x - block - 1].tobytes() for x in nodes]], ["root", "node", "items"], kinds)
        trim()
        return out

    return coded.select(*_SETS).groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(rebuild, "root long, node long, items binary")


def _joined(table: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) of the sets of one unit, group by group. Rows marked ``probe`` are run down the trie of the others only."""
    found: dict[int, list[tuple[int, np.ndarray, bool]]] = {}
    for root, node, items, probe in zip(*(table.column(c).to_pylist() for c in ("root", "node", "items", "probe")), strict=True):
        found.setdefault(root, []).append((node, np.frombuffer(items, dtype=np.uint64), probe))
    a, b = [], []
    for rows in found.values():
        rows.sort(key=lambda x: x[0])
        probes = [k for k, x in enumerate(rows) if x[2]]
        stored = [k for k, x in enumerate(rows) if not x[2]]
        label = trie_components([x[1] for x in rows], percent, probes or None, stored)
        for k, x in enumerate(label):
            if x != k:
                a.append(rows[x][0])
                b.append(rows[k][0])
    trim()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _linked(sets: DataFrame, percent: int, group_shingles: int) -> DataFrame:
    """(node, head) of the sets that are linked with others; head: one of them, the same for all of a component."""

    def join(table: pa.Table) -> pa.Table:
        return _joined(table, percent)

    size = F.octet_length("items")
    groups = sets.groupBy("root").agg(F.sum(size).alias("bytes"), F.count("*").alias("members"), F.ceil(F.sum(size) / 8 / group_shingles).cast("int").alias("blocks"))
    groups = materialise(groups, "sizes")
    large = groups.filter("blocks > 1")
    bundles = int(max(8, (groups.filter("blocks = 1").agg(F.sum("bytes")).first()[0] or 0) // BUNDLE_BYTES))
    small = sets.join(groups.filter("blocks = 1").select("root"), "root", "left_semi")
    small = small.select(F.pmod(F.xxhash64("root"), F.lit(bundles)).alias("unit"), F.lit(0).alias("part"), "root", "node", "items", F.lit(False).alias("probe"))
    schema = "a long, b long"
    if not large.limit(1).count():
        links = small.groupBy("unit", "part").applyInArrow(join, schema)
        return components(links).select("node", F.col("root").alias("head"))
    dealt = materialise(sets.join(large, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("root", "node", "items", "own", "blocks", "members"), "dealt")
    marks = dealt.filter(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 40)) < F.lit(LANDMARKS * (1 << 40)) / F.col("members"))
    marks = marks.select("root", "node", "items", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "own").filter("part <> own")
    unit = lambda df, part, probe: df.select(F.col("root").alias("unit"), F.col(part).alias("part"), "root", "node", "items", F.lit(probe).alias("probe"))
    first = materialise(small.unionByName(unit(dealt, "own", False)).unionByName(unit(marks, "part", False)).groupBy("unit", "part").applyInArrow(join, schema), "links")
    label = components(first).select("node", F.col("root").alias("head"))
    told = materialise(dealt.select("root", "node").join(label, "node", "left").select("root", "node", F.coalesce("head", "node").alias("head")), "told")
    most = told.groupBy("root", "head").count().groupBy("root").agg(F.max_by("head", F.struct("count", "head")).alias("main"))
    others = told.join(most, "root").filter("head <> main").select("node")
    probes = dealt.join(others, "node", "left_semi").select("root", "node", "items", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "own").filter("part <> own")
    pending = told.join(most, "root").filter("head <> main").select("root").distinct()
    stored = dealt.join(pending, "root", "left_semi")
    second = materialise(unit(stored, "own", False).unionByName(unit(probes, "part", True)).groupBy("unit", "part").applyInArrow(join, schema), "links")
    return components(first.unionByName(second)).select("node", F.col("root").alias("head"))


ROWS = "doc_id long, row_hash long, n_shingles long, component long, component_id long"


def join_rows(docs: DataFrame, n: int, percent: int, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """doc_id, row_hash (``xxhash64`` of the text), n_shingles, component (a number that all rows of a component share; null without words) and component_id of every row."""
    docs, spark = columns(docs, "doc_id", "text"), docs.sparkSession
    coded = materialise(_coded(docs, n), "coded")
    total = coded.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    buckets = int(max(8, total // 2 // BUCKET_SHINGLES))
    counted = materialise(_counted(coded, n, buckets), "counted")
    release(spark)

    def describe(batches):
        for batch in batches:
            for block, ids, number, sigs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                least: dict[int, int | None] = {}
                for i, k in zip(ids, unpack_numbers(number).tolist(), strict=True):
                    if k and (k not in least or least[k] is None or (i is not None and i < least[k])):
                        least[k] = i
                m = len(least)
                yield pa.RecordBatch.from_arrays([pa.array([block] * m, pa.int64()), pa.array([block + k for k in least], pa.int64()), pa.array([sigs[16 * k - 16 : 16 * k] for k in least], pa.binary()), pa.array(least.values(), pa.int64())], names=["block", "node", "sig", "least"])

    own = materialise(coded.select("block", "ids", "number", "sigs").mapInArrow(describe, "block long, node long, sig binary, least long"), "own")
    nodes = materialise(own.groupBy("sig").agg(F.min("node").alias("node"), F.min("least").alias("least")), "nodes")
    met = _met(coded, counted, n, percent, buckets)
    # all nodes of a set send the same keys, so they are in one group; a group of one set needs no join
    grouped = nodes.join(met, "node").select("node", "root")
    several = grouped.groupBy("root").count().filter("count > 1").select("root")
    wanted = grouped.join(several, "root", "left_semi").select(_block_of("node").alias("block"), "node", "root")
    sets = materialise(_of_groups(coded, wanted, n), "groups")
    release(spark)
    linked = _linked(sets, percent, group_shingles)
    headed = materialise(nodes.join(linked, "node", "left").select("sig", F.coalesce("head", "node").alias("head"), "least"), "headed")
    heads = headed.groupBy("head").agg(F.min("least").alias("component_id"))
    final = own.select("block", "node", "sig").join(headed.select("sig", "head"), "sig").join(heads, "head").select("block", "node", "head", "component_id")

    kinds = [pa.int64()] * 5

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in ROWS.split(", ")]
        if not left.num_rows:
            return _table([[]] * 5, names, kinds)
        block, ids, rows, number, counts = (left.column(c)[0].as_py() for c in ("block", "ids", "rows", "number", "counts"))
        told = {x - block: (h, c) for x, h, c in zip(*(right.column(c).to_pylist() for c in ("node", "head", "component_id")), strict=True)}
        size, number = [0, *unpack_numbers(counts).tolist()], unpack_numbers(number).tolist()
        out = [told[k] if k else (None, i) for i, k in zip(ids, number, strict=True)]
        return _table([ids, np.frombuffer(rows, "<i8").tolist(), [size[k] for k in number], [o[0] for o in out], [o[1] for o in out]], names, kinds)

    return coded.select("block", "ids", "rows", "number", "counts").groupBy("block").cogroup(final.groupBy("block")).applyInArrow(answer, ROWS)


def join_components(docs: DataFrame, n: int = 3, percent: int = 90, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``; documents link when their sets' similarity is at least ``percent`` / 100."""
    return join_rows(docs, n, percent, group_shingles).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that with the least doc_id (null after all others; of equal ones, the least ``xxhash64`` of the text), with
    all its columns. Of rows that agree in doc_id and text one stays, the first by a hash of all columns. Rows without words stay."""
    found = join_rows(docs, n, percent).filter("component is not null")
    # a struct with a null sorts first, hence the flag
    least = F.min(F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "row_hash"))
    chosen = materialise(found.groupBy("component").agg(least.alias("row")).select("row.doc_id", "row.row_hash"), "chosen")
    # the row in one column, so that none of its names can clash
    key = F.struct(F.coalesce(docs["doc_id"], F.lit(0)).alias("i"), docs["doc_id"].isNull().alias("none"), F.xxhash64(docs["text"]).alias("h"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"))
    wanted = chosen.select(F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("none"), F.col("row_hash").alias("h")).alias("key"))
    kept = rows.join(wanted, "key", "left_semi")
    if found.groupBy("doc_id", "row_hash").count().filter("count > 1").limit(1).count():
        order = F.xxhash64(*[F.to_json(F.struct(F.col(f"row.`{c}`").alias("x"))) for c in docs.columns])
        kept = kept.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy(order))).filter("turn = 1")
    wordless = docs.filter(~F.coalesce(docs["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.select("row.*").unionByName(wordless)
