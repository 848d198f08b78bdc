"""Language-model scores from a probabilistic suffix tree over words.

*Model.* Symbols are the tokens: lower-cased (A-Z) words and the end of a text. A context is the one to ``DEPTH`` tokens
before a token, in its text (before the first stands an end). Contexts that stand at least ``MIN_COUNT`` times in the
training tokens are candidates, at any size of the corpus; one is retained if the divergence (Kullback-Leibler, in nats) of its next symbols
from what its longest retained suffix predicts for them is at least ``MIN_DIVERGENCE``. A token is predicted by the longest retained
suffix of what stands before it, smoothed with the shorter ones (Witten-Bell):
P(w | s) = (c(sw) + T(s) P(w | suffix)) / (c(s) + T(s)), T the number of different next symbols. The root is
(c(w) + 1) / (N + V + 1), with one share for all words that training has not seen, so every distribution adds up to 1.

*Flow.* Input blocks (a few thousand texts) are written once as word numbers. Words are counted by hash over all blocks; the
counts and global numbers (small ones for frequent words) go back to the blocks. All contexts with the same last word
make up one subtree, so each token goes with its history to the bucket of the last word before it, where the
subtree is built to its full depth, and its probability comes back: one exchange for all depths, in ``TURNS`` turns, each of a share of the
buckets, to halve what is on disk at a time.

A context with more than ``HOT`` tokens (estimated from one position in ``SAMPLE``; this chooses the plan, not the result) would
fill a bucket, so it is split: its tokens are dealt by one more word of history, and the distributions of the hot contexts themselves are
counted apart, as (context, symbol) pairs in buckets of symbols. What the driver holds are the hot contexts' totals, at most DEPTH * N / HOT rows.

Null and empty texts are one end token. A null doc_id counts as a training row; repeated rows count each time.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, discard, materialise, pack_numbers, trim, unpack_numbers

DEPTH, MIN_COUNT, MIN_DIVERGENCE = 5, 2, 0.05
HOT, SAMPLE, TURNS = 500_000, 256, 2
BLOCK_DOCS, BLOCK_BYTES, WORD_BUCKET_BYTES, BUCKET_TOKENS = 4000, 6_000_000, 16_000_000, 700_000
_P1 = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = 40  # word numbers take 40 bits of a key


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(columns_: list, schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    names = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns_, names, strict=True)], names=[n for n, _ in names])


# ---- words: numbers and counts

_TEXTS = "block long, ids array<long>, held binary, sizes binary, tokens binary, end long"
_WORDS = "block long, bucket int, words binary, numbers binary, counts binary"


def _blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds. A block's texts: doc_ids, held-out flags, sizes, word numbers and that of the end. A block's words in a bucket: their bytes, numbers and training counts."""
    schema = _TEXTS + ", " + _WORDS.split(", ", 1)[1]

    def reduce_block(block: int, ids: list, texts: list) -> pa.RecordBatch:
        place: dict[bytes, int] = defaultdict()
        place.default_factory = place.__len__  # words are numbered as they come
        flat, sizes = [], []
        for text in texts:
            own = (text or "").encode().lower().split()
            flat += own
            flat.append(b"")
            sizes.append(len(own) + 1)
        tokens = np.fromiter(map(place.__getitem__, flat), dtype=np.int64, count=len(flat))
        del flat
        words, sizes = list(place), np.array(sizes, dtype=np.int64)
        held = np.array([is_held_out(i) for i in ids], dtype=bool)
        order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")  # frequent words get short numbers
        number = np.empty(len(words), dtype=np.int64)
        number[order] = np.arange(len(words))
        tokens, words = number[tokens], [words[i] for i in order.tolist()]
        counted = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(words))
        at = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)) % np.uint64(buckets)
        rows = [(block, ids, held.astype("u1").tobytes(), pack_numbers(sizes), pack_numbers(tokens), int(number[place[b""]]), *[None] * 4)]
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[b] : cuts[b + 1]]
            rows.append((block, *[None] * 5, b, b"\n".join([words[i] for i in mine.tolist()]), pack_numbers(np.diff(mine, prepend=0)), pack_numbers(counted[mine])))
        return _table(list(zip(*rows, strict=True)), schema).to_batches()[0]

    def run(batches):
        part, turn = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.cumsum(np.array([x or 0 for x in pc.binary_length(texts).to_pylist()], dtype=np.int64))
            at = 0
            while at < len(ids):
                floor = sizes[at - 1] if at else 0
                to = min(len(ids), at + BLOCK_DOCS, max(at + 1, int(np.searchsorted(sizes, floor + BLOCK_BYTES, side="right"))))
                yield reduce_block((part << 40) | turn, ids[at:to], texts.slice(at, to - at).to_pylist())
                turn, at = turn + 1, to
                trim()

    return docs.mapInArrow(run, schema)


_TOLD = "block long, numbers binary, globals binary, counts binary, tokens long, kinds long"


def _tell(buckets: int):
    """Each block's words with their training counts and global numbers, which begin at 1 and are smaller for the frequent words of a bucket; and a row for the bucket's tokens and kinds."""

    def run(table: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        where, counts = [], []
        for joined, c in zip(table.column("words").to_pylist(), table.column("counts").to_pylist(), strict=True):
            where.append(np.array([place.setdefault(w, len(place)) for w in joined.split(b"\n")], dtype=np.int64))
            counts.append(unpack_numbers(c))
        total = np.bincount(np.concatenate(where), weights=np.concatenate(counts), minlength=len(place)).astype(np.int64)
        names, left = list(place), total.tolist()
        number = np.empty(len(names), dtype=np.int64)
        number[sorted(range(len(names)), key=lambda i: (-left[i], names[i]))] = np.arange(len(names))
        number = number * buckets + table.column("bucket")[0].as_py() + 1
        n = table.num_rows
        return _table(
            [[*table.column("block").to_pylist(), None], [*table.column("numbers").to_pylist(), None], [*[pack_numbers(number[at]) for at in where], None], [*[pack_numbers(total[at]) for at in where], None], [*[None] * n, int(total.sum())], [*[None] * n, int((total > 0).sum())]],
            _TOLD,
        )

    return run


_CODED = "block long, ids array<long>, held binary, sizes binary, tokens binary, end long, globals binary, counts binary, told binary"


def _coded(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's texts with the global numbers and counts of its words."""
    if not left.num_rows:
        return _table([[]] * 9, _CODED)
    number = np.concatenate([np.cumsum(unpack_numbers(x)) for x in right.column("numbers").to_pylist()])
    order = np.argsort(number)
    globals_, counts = (np.concatenate([unpack_numbers(x) for x in right.column(c).to_pylist()])[order] for c in ("globals", "counts"))
    return _table([*[left.column(c).to_pylist() for c in ("block", "ids", "held", "sizes", "tokens", "end")], [pack_numbers(globals_)], [pack_numbers(counts)], [None]], _CODED)


# ---- a block's tokens and what stands before them


@dataclass
class Settings:
    """What all steps share: totals of the training tokens, the plan, and the hot contexts (for each length, sorted keys ``parent << 40 | word`` and their numbers)."""

    tokens: int
    kinds: int
    depth: int
    least: int
    divergence: float
    buckets: int
    keys: list[np.ndarray] = field(default_factory=list)
    numbers: list[np.ndarray] = field(default_factory=list)
    parent: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    length: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    count: np.ndarray = field(default_factory=lambda: np.zeros(1))
    following: np.ndarray = field(default_factory=lambda: np.zeros(1))
    retained: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=bool))

    def root(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.tokens + self.kinds + 1)

    def add_hot(self, paths: list[tuple[int, ...]]) -> None:
        """Number the hot contexts, given as their words from the last backwards; with a context come all its suffixes."""
        number = {(): 0}
        for path in sorted(paths, key=lambda x: (len(x), x)):
            number[path] = len(number)
        for n in range(1, 1 + max((len(p) for p in paths), default=0)):
            level = sorted(((number[p[:-1]] << _SHIFT) | p[-1], number[p]) for p in paths if len(p) == n)
            self.keys.append(np.array([k for k, _ in level], dtype=np.int64))
            self.numbers.append(np.array([k for _, k in level], dtype=np.int64))
        self.parent = np.array([number[p[:-1]] if p else 0 for p in number], dtype=np.int64)
        self.length = np.array([len(p) for p in number], dtype=np.int64)
        self.count, self.following = np.zeros(len(number)), np.zeros(len(number))
        self.retained = np.zeros(len(number), dtype=bool)


class Block:
    """A block's tokens with the numbers and counts of their words."""

    def __init__(self, row: dict, of: Settings, whole: bool = True):
        self.of, self.ids = of, row["ids"]
        self.sizes, self.held = unpack_numbers(row["sizes"]), np.frombuffer(row["held"], "u1").astype(bool)
        self.tok, self.word, self.count = unpack_numbers(row["tokens"]), unpack_numbers(row["globals"]), unpack_numbers(row["counts"])
        self.end, self.starts = row["end"], np.cumsum(self.sizes) - self.sizes
        self.block, self.train, self.told = row["block"], np.repeat(~self.held, self.sizes), row["told"]
        self.words = np.concatenate([[0], self.word])  # by local number + 1
        self.back = self.histories() if whole else []

    def histories(self) -> list[np.ndarray]:
        """For each length, the local number + 1 of the word so far back, 0 where none stands or a word since then is rare."""
        number = np.where(self.count >= self.of.least, np.arange(1, len(self.count) + 1), 0)
        first = np.zeros(len(self.tok), dtype=bool)
        first[self.starts] = True
        back = np.concatenate([[0], number[self.tok[:-1]]])
        back[first] = number[self.end]
        found = [back]
        for _ in range(1, self.of.depth):
            back = np.concatenate([[0], back[:-1]])
            back[first] = 0
            back[found[-1] == 0] = 0
            found.append(back)
        return found

    def history_of(self, at: np.ndarray) -> list[np.ndarray]:
        """``histories`` of some tokens."""
        number = np.where(self.count >= self.of.least, np.arange(1, len(self.count) + 1), 0)
        start, found = np.repeat(self.starts, self.sizes)[at], []
        for n in range(1, self.of.depth + 1):
            back = np.where(at - n >= start, number[self.tok[np.maximum(at - n, 0)]], np.where(at - n == start - 1, number[self.end], 0))
            found.append(np.where(found[-1] > 0, back, 0) if found else back)
        return found

    def hot(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length: the tokens that have a hot context of it, and its number."""
        found, words = [], self.words
        for cols, keys, numbers in zip(self.back, self.of.keys, self.of.numbers, strict=False):
            if not found:  # one look-up a word
                at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
                own = np.where(keys[at] == words, numbers[at], 0)[cols]
                tokens = np.flatnonzero(own)
            else:
                tokens, before = found[-1]
                key = (before << _SHIFT) | words[cols[tokens]]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = (keys[at] == key) & (cols[tokens] > 0)
                tokens, own = tokens[hit], np.zeros(len(self.tok), dtype=np.int64)
                own[tokens] = numbers[at[hit]]
            found.append((tokens, own[tokens]))
        return found

    def pairs(self) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Distinct (hot context, symbol) pairs in the order of their buckets with training counts and the symbols' counts; and cuts of the buckets."""
        self.levels = self.hot()
        tokens, context = (np.concatenate([x[i] for x in self.levels]) for i in (0, 1))
        bits = np.int64(int(len(self.word)).bit_length())
        names, self.pair = np.unique((context << bits) | self.tok[tokens], return_inverse=True)
        n = np.bincount(self.pair, weights=self.train[tokens], minlength=len(names)).astype(np.int64)
        symbol = names & ((1 << bits) - 1)
        bucket = (_mix(self.word[symbol].astype(np.uint64)) % np.uint64(self.of.buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[self.order], np.arange(self.of.buckets + 1))
        symbol = symbol[self.order]
        return ((names >> bits)[self.order], self.word[symbol], n[self.order], self.count[symbol]), cuts

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each token after its hot contexts, and the length of the longest of these."""
        p, length = self.of.root(self.count)[self.tok], np.zeros(len(self.tok), dtype=np.int64)
        if self.told:
            self.pairs()
            told = np.empty(len(self.order), dtype=np.float32)
            told[self.order] = np.frombuffer(self.told, "<f4")
            at = 0
            for n, (tokens, _) in enumerate(self.levels, 1):
                p[tokens] = told[self.pair[at : at + len(tokens)]]
                length[tokens] = n
                at += len(tokens)
        return p, length

    def dealt(self, length: np.ndarray, turn: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Tokens whose next longer context is yet to be looked up in a bucket of this turn (None: of all turns, one after another), by bucket and last word, and cuts of the buckets."""
        key = _mix(_P1 * self.words.astype(np.uint64))[self.back[0]]
        open_ = (length == 0) & (self.back[0] > 0)
        for n in range(1, self.of.depth):
            longer = np.flatnonzero(length >= n)
            if not len(longer):
                break
            key[longer] = _mix(key[longer] + _P1 * self.words[self.back[n][longer]].astype(np.uint64))
            open_[longer] = (length[longer] == n) & (self.back[n][longer] > 0)
        some = np.flatnonzero(open_)
        bucket = (key[some] % np.uint64(self.of.buckets)).astype(np.int64)
        if turn is not None:
            mine = bucket % TURNS == turn
            some, bucket = some[mine], bucket[mine]
        bucket += (bucket % TURNS) * self.of.buckets if turn is None else 0
        order = np.argsort((bucket << np.int64(int(len(self.words)).bit_length())) | self.back[0][some], kind="stable")
        return some[order], np.searchsorted(bucket[order], np.arange(self.of.buckets + 1))


def _slices(x: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """``pack_numbers`` of each part of ``x`` between cuts."""
    data = pack_numbers(x)
    ends = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, dtype=np.uint8) >= 128) + 1])[cuts]
    return [data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def _width(*columns_: np.ndarray) -> int:
    """Bytes that the greatest number needs."""
    return max(1, -(-int(max((c.max() for c in columns_ if len(c)), default=0)).bit_length() // 8))


def _planes(x: np.ndarray, width: int) -> list[np.ndarray]:
    """The lowest bytes of all numbers, then the next ones, and so on: they compress better apart."""
    return list(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T))


def _from_planes(planes: np.ndarray) -> np.ndarray:
    out = planes[0].astype(np.int64)
    for k in range(1, len(planes)):
        out |= planes[k].astype(np.int64) << np.int64(8 * k)
    return out


# ---- hot contexts


def _hot_paths(coded: DataFrame, of: Settings, blocks: int, hot: int, sample: int) -> list[tuple[int, ...]]:
    """Contexts with about ``hot`` positions or more, as their words from the last backwards; from one position in ``sample``."""
    least = max(1, int(hot / sample / 4 / max(1, blocks)))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block, found = Block(row, of, whole=False), []
                drawn = np.flatnonzero(_mix(np.arange(len(block.tok), dtype=np.uint64) + np.uint64(block.block & 0xFFFF) * _P1) % np.uint64(sample) == 0)
                cols = [block.words[c] for c in block.history_of(drawn)]
                alive, group = np.arange(len(drawn)), np.zeros(len(drawn), dtype=np.int64)
                for n, col in enumerate(cols):
                    keep = col[alive] > 0
                    alive, group = alive[keep], group[keep]
                    _, first, back, count = np.unique((group << _SHIFT) | col[alive], return_index=True, return_inverse=True, return_counts=True)
                    for i in np.flatnonzero(count >= least).tolist():
                        found.append(([int(c[alive[first[i]]]) for c in cols[: n + 1]], int(count[i])))
                    keep = count[back] >= least
                    alive, group = alive[keep], back[keep]
                yield from _table([[x for x, _ in found], [x for _, x in found]], "path array<long>, n long").to_batches()

    sums = coded.mapInArrow(run, "path array<long>, n long").groupBy("path").agg(F.sum("n").alias("n"))
    return [tuple(r["path"]) for r in sums.filter(F.col("n") >= max(1, hot // sample)).select("path").collect()]


_PAIRS = "bucket int, block long, context binary, symbol binary, n binary, seen binary"


def _send_pairs(of: Settings):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, of)
                data, cuts = block.pairs()
                full = np.flatnonzero(np.diff(cuts)).tolist()
                packed = [_slices(x, cuts) for x in data]
                yield from _table([full, [block.block] * len(full), *[[x[b] for b in full] for x in packed]], _PAIRS).to_batches()
                trim()

    return run


def _totals(table: pa.Table) -> pa.Table:
    """The bucket's distinct pairs and their counts over all blocks."""
    context, symbol, n, seen = (unpack_numbers(b"".join(table.column(c).to_pylist())) for c in ("context", "symbol", "n", "seen"))
    order = np.lexsort((symbol, context))
    context, symbol, n, seen = context[order], symbol[order], n[order], seen[order]
    first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (symbol[1:] != symbol[:-1])]))
    data = context[first], symbol[first], np.add.reduceat(n, first), seen[first]
    return _table([[table.column("bucket")[0].as_py()], *[[x.astype("<i8").tobytes()] for x in data]], "bucket int, context binary, symbol binary, n binary, seen binary")


def _chain(of: Settings, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, seen: np.ndarray, to: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs sorted by (context, symbol): what the contexts of up to ``to`` words predict, and what their longest retained suffix does."""
    after, before = np.zeros(len(n)), np.zeros(len(n))
    symbols, back = np.unique(symbol, return_inverse=True)
    key = context * len(symbols) + back
    for length in range(1, to + 1):
        own = np.flatnonzero(of.length[context] == length)
        up = of.parent[context[own]]
        before[own] = of.root(seen[own]) if length == 1 else after[np.searchsorted(key, up * len(symbols) + back[own])]
        c, kinds = of.count[context[own]], of.following[context[own]]
        after[own] = np.where(of.retained[context[own]], (n[own] + kinds * before[own]) / np.maximum(c + kinds, 1), before[own])
    return after, before


def _read_totals(row: dict) -> list[np.ndarray]:
    return [np.frombuffer(row[c], "<i8") for c in ("context", "symbol", "n", "seen")]


def _describe_hot(totals: DataFrame, of: Settings) -> None:
    """Fill in the counts, next symbols and verdicts of the hot contexts, the shorter ones first."""

    def sizes(batches):
        for batch in batches:
            for row in batch.to_pylist():
                context, _, n, _ = _read_totals(row)
                names, back = np.unique(context, return_inverse=True)
                yield from _table([names, np.bincount(back, weights=n).astype(np.int64), np.bincount(back, weights=n > 0).astype(np.int64)], "context long, n long, kinds long").to_batches()

    for r in totals.mapInArrow(sizes, "context long, n long, kinds long").groupBy("context").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        of.count[r["context"]], of.following[r["context"]] = r["n"], r["kinds"]
    for length in range(1, len(of.keys) + 1):

        def gains(batches, length=length):
            for batch in batches:
                for row in batch.to_pylist():
                    context, symbol, n, seen = _read_totals(row)
                    _, before = _chain(of, context, symbol, n, seen, length)
                    own = np.flatnonzero((of.length[context] == length) & (n > 0))
                    share = n[own] / of.count[context[own]]
                    names, back = np.unique(context[own], return_inverse=True)
                    yield from _table([names, np.bincount(back, weights=share * np.log(share / before[own]), minlength=len(names))], "context long, gain double").to_batches()

        for r in totals.mapInArrow(gains, "context long, gain double").groupBy("context").agg(F.sum("gain").alias("gain")).collect():
            of.retained[r["context"]] = of.count[r["context"]] >= of.least and r["gain"] >= of.divergence


_ANSWERS = "block long, bucket int, p binary"


def _answer_pairs(of: Settings):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([[]] * 3, _ANSWERS)
        context, symbol, n, seen = _read_totals(right.to_pylist()[0])
        after, _ = _chain(of, context, symbol, n, seen, len(of.keys))
        symbols = np.unique(symbol)
        key, out = context * len(symbols) + np.searchsorted(symbols, symbol), []
        for c, s in zip(left.column("context").to_pylist(), left.column("symbol").to_pylist(), strict=True):
            at = np.searchsorted(key, unpack_numbers(c) * len(symbols) + np.searchsorted(symbols, unpack_numbers(s)))
            out.append(after[at].astype("<f4").tobytes())
        return _table([left.column("block").to_pylist(), left.column("bucket").to_pylist(), out], _ANSWERS)

    return run


# ---- subtrees


#: A block's tokens for a bucket: how many (m), the widths of word numbers and counts, planes of history, symbol, count, training flag and hot length, and the
#: probabilities after hot contexts.
_ENTRIES = "bucket int, block long, m int, width int, wide int, data binary, p binary"


def _send_tokens(of: Settings, turn: int):
    """A block's tokens with their histories for the buckets of a turn. Where a hot context has been looked up, its length and the probability after it come along."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, of)
                p, length = block.known()
                own, cuts = block.dealt(length, turn)
                symbol, seen = block.word[block.tok[own]], block.count[block.tok[own]]
                width, wide = _width(block.word), _width(block.count)
                planes = [y for c in block.back for y in _planes(block.words[c[own]], width)]
                planes += [*_planes(symbol, width), *_planes(seen, wide), block.train[own].astype(np.uint8), length[own].astype(np.uint8)]
                hot, p = length[own] > 0, p[own].astype("<f4")
                out = []
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    x = slice(cuts[b], cuts[b + 1])
                    data = pa.compress(b"".join([y[x].tobytes() for y in planes]), codec="zstd", asbytes=True)
                    out.append((b, block.block, int(cuts[b + 1] - cuts[b]), width, wide, data, p[x][hot[x]].tobytes()))
                if out:
                    yield from _table(list(zip(*out, strict=True)), _ENTRIES).to_batches()
                del block, planes, out
                trim()

    return run


def subtree(history: list[np.ndarray], symbol: np.ndarray, n: np.ndarray, p: np.ndarray, skip: np.ndarray, least: int, divergence: float) -> np.ndarray:
    """The probabilities of tokens (history from the last word backwards, symbol, training count) after all their contexts. ``p``: before, ``skip``: how many words of history that has used."""
    p, group, alive = p.copy(), np.zeros(len(symbol), dtype=np.int32), np.arange(len(symbol), dtype=np.int32)
    for length in range(1, len(history) + 1):
        words, history[length - 1] = history[length - 1], None  # each is read once, and freed
        alive = alive[words[alive] > 0]
        if not len(alive):
            break
        _, g = np.unique((group[alive].astype(np.int64) << _SHIFT) | words[alive], return_inverse=True)
        del words
        own, stands = skip[alive] < length, np.bincount(g, weights=n[alive])
        stay = ~own | (stands[g] >= least)
        alive, g, own = alive[stay], g[stay], own[stay]
        pairs, first, back = np.unique((g << _SHIFT) | symbol[alive], return_index=True, return_inverse=True)
        c, context = np.bincount(back, weights=n[alive], minlength=len(pairs)), pairs >> _SHIFT
        seen = c > 0
        share = c[seen] / stands[context[seen]]
        kinds = np.bincount(context[seen], minlength=len(stands))
        gain = np.bincount(context[seen], weights=share * np.log(share / p[alive[first[seen]]]), minlength=len(stands))
        use = own & (gain >= divergence)[g]
        at, g_at = alive[use], g[use]
        p[at] = (c[back[use]] + kinds[g_at] * p[at]) / (stands[g_at] + kinds[g_at])
        group[alive] = g
    return p


def _grow(of: Settings):
    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("m").to_pylist()
        cuts = np.cumsum([0, *sizes])
        if cuts[-1] >= 1 << 23:
            raise ValueError("a bucket has more than eight million tokens: lower HOT or BUCKET_TOKENS")
        widths, wides = table.column("width").to_pylist(), table.column("wide").to_pylist()
        kind = np.int32 if max(*widths, *wides) < 4 else np.int64
        columns_ = [np.empty(cuts[-1], dtype=kind) for _ in range(of.depth + 2)]  # history, symbol, count
        train, skip = np.empty(cuts[-1], dtype=np.uint8), np.empty(cuts[-1], dtype=np.uint8)
        for at, m, width, wide, data in zip(cuts.tolist(), sizes, widths, wides, table.column("data"), strict=False):
            planes = (of.depth + 1) * width + wide + 2
            got = np.frombuffer(pa.decompress(data.as_buffer(), decompressed_size=planes * m, codec="zstd"), dtype=np.uint8).reshape(planes, m)
            for k in range(of.depth + 1):
                columns_[k][at : at + m] = _from_planes(got[k * width : (k + 1) * width])
            columns_[-1][at : at + m] = _from_planes(got[(of.depth + 1) * width : -2])
            train[at : at + m], skip[at : at + m] = got[-2], got[-1]
        blocks, bucket, p_hot = (table.column(c).to_pylist() for c in ("block", "bucket", "p"))
        del table
        p = of.root(columns_.pop().astype(np.int64))
        p[skip > 0] = np.frombuffer(b"".join(p_hot), "<f4")
        symbol = columns_.pop()
        p = subtree(columns_, symbol, train, p, skip, of.least, of.divergence).astype("<f4")
        out = [p[a:b].tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
        trim()
        return _table([blocks, bucket, out], _ANSWERS)

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _add_up(of: Settings):
    """The rows of a block's texts from the answers of the subtrees."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([[]] * 7, _SCORES)
        block = Block(left.to_pylist()[0], of)
        p, length = block.known()
        own, _ = block.dealt(length)
        if len(own):
            told = sorted(zip(right.column("bucket").to_pylist(), right.column("p").to_pylist(), strict=True), key=lambda x: (x[0] % TURNS, x[0]))
            p[own] = np.frombuffer(b"".join([x for _, x in told]), "<f4")
        add = lambda x: np.add.reduceat(x, block.starts)
        base = np.log10(of.root(block.count))[block.tok]
        out = [block.ids, block.held, block.sizes, add((block.count[block.tok] > 0).astype(np.int64)), [of.tokens] * len(block.ids), add(base), add(np.log10(p))]
        trim()
        return _table(out, _SCORES)

    return run


def _written(docs: DataFrame, bytes_in: int) -> tuple[DataFrame, int, int]:
    """Blocks as global word numbers, the training tokens, and the kinds of words among them."""
    buckets = int(max(8, -(-bytes_in // WORD_BUCKET_BYTES)))
    names = lambda schema: [x.split()[0] for x in schema.split(", ")]
    blocks = materialise(_blocks(docs, buckets), "blocks")
    words = blocks.filter("bucket is not null").select(*names(_WORDS))
    told = materialise(words.groupBy("bucket").applyInArrow(_tell(buckets), _TOLD), "told")
    totals = told.agg(F.sum("tokens"), F.sum("kinds")).first()
    texts = blocks.filter("bucket is null").select(*names(_TEXTS))
    answers = told.filter("block is not null").select("block", "numbers", "globals", "counts")
    coded = materialise(texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_coded, _CODED), "coded")
    discard(blocks)
    discard(told)
    return coded, int(totals[0] or 0), int(totals[1] or 0)


def _with_hot_contexts(coded: DataFrame, of: Settings) -> DataFrame:
    """Describe the hot contexts, and put into each block's row what they predict for its pairs."""
    sent = materialise(coded.mapInArrow(_send_pairs(of), _PAIRS), "pairs")
    totals = materialise(sent.groupBy("bucket").applyInArrow(_totals, "bucket int, context binary, symbol binary, n binary, seen binary"), "totals")
    _describe_hot(totals, of)
    asked = sent.select("bucket", "block", "context", "symbol").groupBy("bucket")
    answers = asked.cogroup(totals.groupBy("bucket")).applyInArrow(_answer_pairs(of), _ANSWERS)

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left
        rows = right.column("p").to_pylist()
        told = b"".join([rows[i] for i in np.argsort(right.column("bucket").to_numpy())])
        return left.set_column(left.schema.get_field_index("told"), "told", pa.array([told], pa.binary()))

    out = materialise(coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(put, _CODED), "coded")
    for done in (sent, totals, coded):
        discard(done)
    return out


def _of_subtrees(coded: DataFrame, of: Settings) -> DataFrame:
    """The probabilities of each block's tokens: a table for each turn, so that the shuffle files of one turn only are on disk at a time."""
    sent = [coded.mapInArrow(_send_tokens(of, turn), _ENTRIES) for turn in range(TURNS)]
    return reduce(DataFrame.unionByName, [materialise(x.groupBy("bucket").applyInArrow(_grow(of), _ANSWERS), "grown") for x in sent])


def scores(docs: DataFrame, depth: int = DEPTH, least: int = MIN_COUNT, divergence: float = MIN_DIVERGENCE, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    docs = columns(docs, "doc_id", "text")
    coded, tokens, kinds = _written(docs, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    size = coded.agg(F.count("*"), F.sum(F.octet_length("tokens"))).first()
    of = Settings(tokens, kinds, depth, least, divergence, int(max(8, (size[1] or 0) // 2 // BUCKET_TOKENS)))
    of.add_hot(_hot_paths(coded, of, size[0], hot, sample))
    if of.keys:
        coded = _with_hot_contexts(coded, of)
    return coded.groupBy("block").cogroup(_of_subtrees(coded, of).groupBy("block")).applyInArrow(_add_up(of), _SCORES)
