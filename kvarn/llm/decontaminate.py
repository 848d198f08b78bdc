"""Benchmark decontamination by latent semantic retrieval and a check of word order.

*Space.* Words are hashed into ``FEATURES``; their document frequencies and occurrences are counted over all documents. A randomised
subspace iteration over the TF-IDF matrix of all documents (a row for each, none left out; no sample is drawn) finds its ``DIMENSIONS`` leading right
singular vectors; each round is one distributed product with the matrix, whose words' numbers and counts are written once, those of
some documents in one row of the table; words that many documents hold are multiplied as dense blocks. The space knows the
corpus and not the benchmark, and has far fewer dimensions than words. Dimensions are scaled to equal
spread, as the first ones tell little but the language.

*Search.* Every passage (``WINDOW`` words every ``STRIDE``) of every text is folded in and compared with all items by cosine, in one pass over the texts. The least cosine of an item is
calibrated: copies of it with words replaced, as many as the checks allow, are made up (the words by their share of all occurrences in the corpus), and
all but a share of ``MISSED`` of them must reach it. So the threshold depends on the item and not on the size of the corpus.

*Check.* First the candidates' words are compared by a sketch (a random projection of the TF-IDF vectors to ``SKETCH`` dimensions, its threshold
calibrated in the same way), and the words around by their numbers, of which too few can be the item's; this spares most of them the rest. A candidate passage is accepted by the longest common subsequence (LCS) of the item's words and the passage's surroundings
(``SURE_LCS`` of the item), or by a shorter one (``LIKELY_LCS``) that also holds the item's answer, its last sentence. Every
candidate passage is tried, so a text holds an item if any of its passages does; of several, that with the longest
subsequence is reported, the first of equal ones.

An index of ``INDEX_ITEMS`` items is broadcast at most; a larger benchmark is read in blocks, with a pass for each.
Texts are read whole and never shuffled. Null and empty texts and items match nothing; repeated rows match alike, null ids like others. Very
long texts are read in chunks that overlap.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, discard, materialise, trim

WINDOW, STRIDE, FEATURES, DIMENSIONS, SKETCH = 24, 8, 1 << 14, 128, 64
EXTRA_DIMENSIONS, ROUNDS, FILL, SUMS = 16, 3, 1 << 16, 4
#: Features in a greater share of the documents are multiplied as dense blocks, the others one document at a time; and how many candidates are checked at a time.
OFTEN, PENDING = 0.03, 1 << 16
#: Of no effect: the space is fitted on all documents. Kept for callers that set it.
SAMPLE_PASSAGES = 0
INDEX_ITEMS, DRAWS, MISSED, MARGIN = 50_000, 48, 0.02, 0.85
SURE_LCS, LIKELY_LCS, ANSWER_LCS = 0.7, 0.5, 0.6
BLOCK, CHUNK, BAG = 1 << 15, 2048, 1 << 10
_PLAIN = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words of all scripts; ASCII punctuation parts them."""
    return (text or "").lower().encode().translate(_PLAIN).split()


def answer(text: str | None) -> list[bytes]:
    """The words of the last sentence."""
    parts = [w for s in re.split(r"[.!?\n]+", text or "") if (w := words(s))]
    return parts[-1] if parts else []


def common_subsequence(pattern: list[bytes], text: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over the pattern."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(pattern)) - 1
    row = full
    for w in text:
        hit = row & where.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(pattern) - row.bit_count()


def orthonormal(y: np.ndarray) -> np.ndarray:
    """Columns made orthonormal (Gram-Schmidt, twice); dependent columns are left out. ``y`` is overwritten."""
    rows, n = np.ascontiguousarray(y.T), 0
    for v in rows:
        size = np.sqrt((v * v).sum())
        for _ in range(2):
            v -= np.einsum("ij,i->j", rows[:n], np.einsum("ij,j->i", rows[:n], v))
        left = np.sqrt((v * v).sum())
        if left > 1e-6 * max(size, 1e-30):
            rows[n] = v / left
            n += 1
    return rows[:n].T


_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as many as were needed so far."""

    size, up, down = 0, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, BLOCK)
            self.up, self.down = (np.cumprod(np.array([1] + [b] * (self.size - 1), dtype=np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_powers = _Powers()


class Split:
    """The words of several texts: their places in one buffer, their features, and the first word of each text (and the end)."""

    def __init__(self, texts: list[str | None]):
        self._read([(t or "").lower().encode() for t in texts])

    @classmethod
    def of_words(cls, ws: list[bytes]) -> Split:
        out = cls.__new__(cls)
        out._read([b" ".join(ws)])
        return out

    def _read(self, parts: list[bytes]) -> None:
        self.raw = b" ".join(parts).translate(_PLAIN)
        data = np.frombuffer(self.raw, dtype=np.uint8)
        inside = np.zeros(len(data) + 2, dtype=bool)
        np.not_equal(data, 32, out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum([len(x) + 1 for x in parts])]))
        self.ids = np.zeros(len(self.start), dtype=np.int32)
        at = 0
        while at < len(self.start):  # blocks of whole words: sums of powers over a word, moved to its start
            low = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.end, low + BLOCK, "right")))
            high = int(self.end[to - 1])
            up, down = _powers.upto(high - low)
            sums = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(data[low:high] * up, out=sums[1:])
            own = self.start[at:to] - low
            h = (sums[self.end[at:to] - low] - sums[own]) * down[own]
            self.ids[at:to] = ((h ^ (h >> np.uint64(32))) * _MIX >> np.uint64(32)) % np.uint64(FEATURES)
            at = to

    def __len__(self) -> int:
        return len(self.first) - 1

    def words(self, low: int, high: int) -> list[bytes]:
        return self.raw[self.start[low] : self.end[high - 1]].split() if low < high else []

    def text(self, k: int) -> np.ndarray:
        """The features of a text."""
        return self.ids[self.first[k] : self.first[k + 1]]

    def bags(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct features of each text in turn, how often each stands there, and how many each text has (texts without words left out)."""
        key = np.repeat(np.arange(len(self), dtype=np.int64) * FEATURES, np.diff(self.first)) + self.ids
        if not len(key):
            return (np.zeros(0, dtype=np.int64),) * 3
        key.sort()
        at = np.flatnonzero(np.diff(key, prepend=-1))
        held, sizes = key[at] // FEATURES, np.diff(at, append=len(key))
        counts = np.bincount(held)
        return key[at] % FEATURES, sizes, counts[counts > 0]


def features(ws: list[bytes]) -> np.ndarray:
    """Numbers of the words' features."""
    return Split.of_words(ws).ids


def passage_starts(n: int) -> np.ndarray:
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else np.zeros(0, dtype=np.int64)


class Space:
    """The latent space and the sketch: what a word's occurrence adds to a passage's coordinates in each (``rows``; the last row, zeros, is for no word)."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, spread: np.ndarray, fill: np.ndarray):
        self.fill, self.latent = fill, basis.shape[1]  # fill: features as they stand in the corpus
        self.rows = np.zeros((len(idf) + 1, self.latent + SKETCH), dtype=np.float32)
        self.rows[:-1, : self.latent] = basis / np.maximum(spread, 1e-9)
        self.rows[:-1, self.latent :] = np.random.default_rng(5).integers(0, 2, size=(len(idf), SKETCH), dtype=np.int8) * 2 - 1
        self.rows[:-1] *= idf[:, None].astype(np.float32)

    def unit(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors in the latent space, and in the sketch."""
        parts = sums[:, : self.latent], sums[:, self.latent :]
        latent, sketch = (x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None] for x in parts)
        return latent, sketch

    def passages(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors (see ``unit``) of the passages of texts given as features, with their text's place and their start."""
        steps = [-(-len(t) // STRIDE) for t in texts]
        span = WINDOW // STRIDE
        ids = np.full((sum(steps) + len(texts) * (span - 1)) * STRIDE, FEATURES, dtype=np.int32)  # texts end with no words, so passages don't run on
        at, first = 0, []
        for t, n in zip(texts, steps, strict=True):
            first.append(at)
            ids[at * STRIDE : at * STRIDE + len(t)] = t
            at += n + span - 1
        if not at:
            return self.unit(np.zeros((0, self.rows.shape[1]), dtype=np.float32)), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        sums = self.rows[ids[::STRIDE]]
        room = np.empty_like(sums)
        for k in range(1, STRIDE):  # the rows of a step's words, one word of every step at a time
            sums += np.take(self.rows, ids[k::STRIDE], axis=0, out=room, mode="clip")
        whole = sums.copy()
        for k in range(1, span):
            whole[: len(sums) - k] += sums[k:]
        own = np.repeat(np.arange(len(texts)), steps)
        place = np.concatenate([np.arange(n) for n in steps]) if len(steps) else np.zeros(0, dtype=np.int64)
        return self.unit(whole[np.repeat(first, steps) + place]), own, place * STRIDE


def learn(documents: DataFrame, seed: int = 11) -> Space:
    """The space of a corpus: one pass counts features over all documents and writes each document's, ``ROUNDS`` more read these."""

    def count(batches):
        texts, held, stood = 0, np.zeros(FEATURES, dtype=np.int64), np.zeros(FEATURES, dtype=np.int64)
        for batch in batches:
            out = []
            for _, some in _slices(batch.column(0)):
                split = Split(some)
                texts += len(split)
                stood += np.bincount(split.ids, minlength=FEATURES)
                own, times, sizes = split.bags()
                held += np.bincount(own, minlength=FEATURES)
                if len(own):
                    out.append((own.astype(np.int16).tobytes(), times.astype(np.min_scalar_type(times.max())).tobytes(), sizes.astype(np.int16).tobytes()))
            packed = zip(*out, strict=True) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.binary()) for x in packed], *[pa.nulls(len(out), pa.int64())] * 3], names=names)
        trim()
        some = np.concatenate([np.flatnonzero(held), [FEATURES]])
        tallies = [pa.array(some, pa.int64()), pa.array(np.append(held, texts)[some]), pa.array(np.append(stood, 0)[some])]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some), pa.binary())] * 3, *tallies], names=names)

    names = ["own", "times", "sizes", "k", "held", "stood"]
    read = materialise(documents.select("text").mapInArrow(count, "own binary, times binary, sizes binary, k long, held long, stood long"), "read")
    counts = {r["k"]: (r["n"], r["m"]) for r in read.filter("k is not null").groupBy("k").agg(F.sum("held").alias("n"), F.sum("stood").alias("m")).collect()}  # a row for each feature
    df, stood = np.array([counts.get(k, (0, 0)) for k in range(FEATURES)], dtype=np.float64).T
    texts = counts.get(FEATURES, (0, 0))[0]
    idf = np.log((texts + 2) / (df + 1))
    # features by their share of all occurrences, at equal steps
    fill = np.searchsorted(np.cumsum(stood), (np.arange(FILL) + 0.5) / FILL * stood.sum()).astype(np.int32) if stood.any() else np.zeros(0, dtype=np.int32)
    matrix, q = read.filter("own is not null").select("own", "times", "sizes"), np.zeros((FEATURES, 0))
    basis, spread = q, np.ones(0)
    rng, width = np.random.default_rng(seed), DIMENSIONS + EXTRA_DIMENSIONS
    for turn in range(ROUNDS if len(fill) else 0):
        if turn == 0:  # random signs, one a row, in a random column: the cheapest start
            q = np.zeros((FEATURES, width), dtype=np.float32)
            q[np.arange(FEATURES), rng.integers(0, width, FEATURES)] = rng.integers(0, 2, FEATURES) * 2 - 1
        else:
            q = orthonormal(product)
        product = _product(matrix, idf, df / max(texts, 1), q)
        if not product.any():  # every word is in every document
            break
    else:
        if q.shape[1]:
            basis, spread = _leading(q, product)
    discard(read)
    return Space(idf, basis, spread, fill)


def _leading(q: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors and singular values of A from q (orthonormal) and A'Aq, as A'A is nearly (A'Aq)(q'A'Aq)^-1(A'Aq)' (Nystroem)."""
    small = np.einsum("ij,ik->jk", q, product)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    sound = values > 1e-9 * values.max()
    half = np.einsum("ij,jk->ik", product, turned[:, sound] / np.sqrt(values[sound]))  # half half' is that approximation
    values, turned = np.linalg.eigh(np.einsum("ij,ik->jk", half, half))
    leading = [k for k in np.argsort(-values)[:DIMENSIONS] if values[k] > 1e-9 * values.max()]
    spread = np.sqrt(values[leading])
    return np.einsum("ij,jk->ik", half, turned[:, leading]) / spread, spread


def _product(matrix: DataFrame, idf: np.ndarray, share: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'Aq for the documents' TF-IDF matrix A: a block of the size of q from each task, summed by a few tasks and then here. ``share``: of the documents that hold a feature."""
    order = np.argsort(-share, kind="stable")  # features from frequent to rare
    rank, often = np.empty(len(order), dtype=np.int16), int((share > OFTEN).sum())
    rank[order] = np.arange(len(order))
    q, idf = q[order], idf[order]
    shipped = matrix.sparkSession.sparkContext.broadcast((np.ascontiguousarray(q, dtype=np.float32), idf.astype(np.float32), rank))  # FEATURES times the dimensions; a feature's row in one place
    shape, step = q.shape, 1024
    column = np.argmax(q != 0, axis=1) if (np.count_nonzero(q, axis=1) <= 1).all() else None  # where rows have one number, that column
    value = None if column is None else q[np.arange(len(q)), column].astype(np.float32)

    def run(batches):
        right, weight, rank = shipped.value
        total = np.zeros(right.shape, dtype=np.float32)
        room = np.empty((2, *right.shape), dtype=np.float32)  # for rows of both, without new memory for each document
        for batch in batches:
            for own, times, sizes in zip(*[batch.column(k) for k in range(3)], strict=True):  # some documents a row
                own, sizes = rank[np.frombuffer(own.as_buffer(), dtype=np.int16)], np.frombuffer(sizes.as_buffer(), dtype=np.int16)
                times = np.frombuffer(times.as_buffer(), dtype=f"u{len(times.as_buffer()) // len(own)}")
                ends, doc = np.cumsum(sizes, dtype=np.int64), np.repeat(np.arange(len(sizes)), sizes)
                a = np.log1p(times, dtype=np.float32)
                a *= weight[own]
                size = np.sqrt(np.add.reduceat(a * a, ends - sizes))
                a /= np.repeat(np.where(size > 0, size, np.float32(1)), sizes)
                common = own < often
                dense = np.zeros((len(sizes), often), dtype=np.float32)
                dense[doc[common], own[common]] = a[common]
                if column is None:
                    through = dense @ right[:often]
                else:
                    through = np.bincount(doc * shape[1] + column[own], a * value[own], len(sizes) * shape[1]).astype(np.float32).reshape(-1, shape[1])
                own, a = own[~common], a[~common]
                ends, low = np.cumsum(np.bincount(doc[~common], minlength=len(sizes))).tolist(), 0
                for k, high in enumerate(ends):
                    if low < high:
                        some, part, (rows, sums) = own[low:high], a[low:high], room[:, : high - low]
                        if column is None:
                            np.take(right, some, axis=0, out=rows, mode="clip")
                            through[k] += part @ rows
                        np.multiply(part[:, None], through[k], out=rows)
                        sums = np.take(total, some, axis=0, out=sums, mode="clip")
                        sums += rows
                        total[some] = sums
                    low = high
                total[:often] += dense.T @ through
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])
        trim()

    def add(batches):
        total = np.zeros(shape)
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_buffer(), dtype=np.float32).reshape(shape)
        for at in range(0, shape[0], step):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total[at : at + step].astype(np.float32).tobytes()], pa.binary())], names=["at", "part"])
        trim()

    parts = materialise(matrix.mapInArrow(run, "part binary"), "parts")
    total = np.zeros(shape)
    for at, part in parts.coalesce(SUMS).mapInArrow(add, "at int, part binary").toLocalIterator():  # a task's at a time
        total[at : at + step] += np.frombuffer(part, dtype=np.float32).reshape(-1, shape[1])
    shipped.destroy()
    discard(parts)
    trim()
    out = np.empty(shape)
    out[order] = total
    return out


def altered(item: np.ndarray, tail: int, fill: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A copy (as features) with words replaced by words as they stand in the corpus, or by any, as many as the checks allow: SURE_LCS of the item stay, or LIKELY_LCS with the answer, its last ``tail`` words."""
    likely = 0 < tail < len(item) and rng.random() < 0.5
    fill = fill if rng.random() < 0.5 else np.arange(FEATURES, dtype=np.int32)
    free = len(item) - tail if likely else len(item)
    count = min(free, int((1 - (LIKELY_LCS if likely else SURE_LCS)) * len(item)))
    out = item.copy()
    out[rng.choice(free, count, replace=False)] = rng.choice(fill, count)
    return np.concatenate([rng.choice(fill, int(rng.integers(STRIDE))), out])


class Index:
    """Items in the latent space, with their words, answers and least cosines."""

    def __init__(self, space: Space, items: list[tuple[int, str]]):
        self.space = space
        self.items = [(i, ws, answer(t)) for i, t in items if (ws := words(t))]
        self.counts = [dict(Counter(ws)) for _, ws, _ in self.items]
        self.sizes = np.array([len(ws) for _, ws, _ in self.items], dtype=np.int64)
        bags = [np.unique(features(ws) & (BAG - 1), return_counts=True) for _, ws, _ in self.items]
        self.held = np.array([len(x) for x, _ in bags], dtype=np.int64)  # an item's words in each of BAG bins: so many bins, these, so many words in each
        self.bins, self.times = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*bags, strict=True) if bags else ((), ())))
        sums = np.array([space.rows[features(ws)].sum(axis=0) for _, ws, _ in self.items], dtype=np.float32).reshape(len(self.items), space.rows.shape[1])
        self.latent, self.sketch = space.unit(sums)
        self.least, self.least_shared = np.array([self._least(k) for k in range(len(self.items))], dtype=np.float32).reshape(-1, 2).T

    def _least(self, k: int) -> tuple[float, float]:
        """The cosines in the latent space and in the sketch that all but MISSED of the item's altered copies reach with their nearest passage (in the space)."""
        _, ws, tail = self.items[k]
        own, rng = features(ws), np.random.default_rng(k)
        fill = self.space.fill if len(self.space.fill) else own
        (latent, sketch), text, _ = self.space.passages([altered(own, len(tail), fill, rng) for _ in range(DRAWS)])
        near, shared = np.einsum("ij,j->i", latent, self.latent[k]), np.einsum("ij,j->i", sketch, self.sketch[k])
        best = np.full(DRAWS, -1.0)
        np.maximum.at(best, text, near)
        least = MARGIN * float(np.quantile(best, MISSED, method="lower"))
        # the passage that passes the first test must pass the second as well
        both = np.full(DRAWS, -1.0)
        np.maximum.at(both, text, np.where(near >= least, shared, -1.0))
        return least, MARGIN * float(np.quantile(both, MISSED, method="lower"))

    def search(self, texts: list[str | None]) -> list[tuple[int, int, float, float, float]]:
        """(place of the text, item_id, cosine, LCS share, answer share) for the items that each text holds."""
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not self.items:
            return []
        split = Split(texts)
        ends = split.first[1:]
        at, found, pending = 0, [], 0
        while at < len(split):  # chunks of texts
            low = int(split.first[at])
            to = max(at + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
            if to == at + 1 and ends[at] - low > CHUNK:  # of a long text, in chunks that overlap
                chunks = ([(at, first, split.ids[first : min(first + CHUNK + WINDOW, ends[at])])] for first in range(low, int(ends[at]), CHUNK))
            else:
                chunks = ([(k, int(split.first[k]), split.text(k)) for k in range(at, to)],)
            for parts in chunks:
                for some in self._candidates(parts):
                    found.append(some)
                    pending += len(some[0])
                    if pending >= PENDING:
                        self._settle(split, found, out)
                        found, pending = [], 0
            at = to
        self._settle(split, found, out)
        return [(t, self.items[k][0], *hit) for (t, k), hit in sorted(out.items())]

    def _candidates(self, parts: list[tuple[int, int, np.ndarray]]):
        """Passages and items whose cosines suffice: place of the text, first word, item, cosine."""
        (v, sketch), own, start = self.space.passages([ids for _, _, ids in parts])
        place, first = np.array([p[0] for p in parts])[own], np.array([p[1] for p in parts])[own] + start
        for low in range(0, len(self.items), 1024):
            cos = v @ self.latent[low : low + 1024].T
            at = np.flatnonzero(cos >= self.least[low : low + 1024])
            r, c = np.divmod(at, cos.shape[1])
            some = np.einsum("ij,ij->i", sketch[r], self.sketch[low + c]) >= self.least_shared[low + c]
            r, c = r[some], c[some]
            yield place[r], first[r], low + c, cos.ravel()[at[some]]

    def _settle(self, split: Split, found: list, out: dict) -> None:
        """Check candidates, in their order."""
        if not found:
            return
        place, first, k, cos = (np.concatenate(x) for x in zip(*found, strict=True))
        some = self._possible(split, place, first, k)
        for x in zip(*(y[some].tolist() for y in (place, k, first, cos)), strict=True):
            self._check(split, *x, out)

    def _around(self, split: Split, place, first, k) -> tuple:
        """First and last word (exclusive) of passages' surroundings."""
        return np.maximum(split.first[place], first - self.sizes[k]), np.minimum(split.first[place + 1], first + WINDOW + self.sizes[k])

    def _possible(self, split: Split, place: np.ndarray, first: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether enough of the surroundings' words can be the item's, by their features: no passage that the check takes is left out."""
        low, high = self._around(split, place, first, k)
        out = np.zeros(len(k), dtype=bool)
        width = int((high - low).max(initial=0))
        step, begins = max(1, (1 << 18) // max(BAG, width)), np.cumsum(self.held) - self.held
        for at in range(0, len(k), step):
            part = slice(at, at + step)
            own = k[part]
            held = self.held[own]
            begin = np.cumsum(held) - held
            bins = np.repeat(begins[own] - begin, held) + np.arange(held.sum())
            where = low[part, None] + np.arange(width)
            there, row = np.zeros(len(own) * BAG, dtype=bool), np.arange(0, len(own) * BAG, BAG)
            there[(split.ids.take(np.minimum(where, high[part, None] - 1)) & (BAG - 1)) + row[:, None]] = True
            shared = np.add.reduceat(self.times[bins] * there[self.bins[bins] + np.repeat(row, held)], begin)
            out[part] = shared >= LIKELY_LCS * self.sizes[own]
        return out

    def _check(self, split: Split, place: int, k: int, s: int, cos: float, out: dict) -> None:
        _, pattern, tail = self.items[k]
        best = out.get((place, k))
        if best is not None and best[1] >= 1.0:
            return
        around = split.words(*self._around(split, place, s, k))
        held = self.counts[k]
        if sum([held[w] for w in held.keys() & set(around)]) < LIKELY_LCS * len(pattern):  # of the item's words, no more can be in a subsequence
            return
        share = common_subsequence(pattern, around) / len(pattern)
        if share < LIKELY_LCS or (best is not None and share <= best[1]):
            return
        ends = common_subsequence(tail, around) / len(tail) if tail else 0.0
        if share >= SURE_LCS or ends >= ANSWER_LCS:
            out[place, k] = (cos, share, ends)


def _item_blocks(benchmark: DataFrame):
    """The benchmark's items, INDEX_ITEMS at a time."""
    block: list[tuple[int, str]] = []
    for r in columns(benchmark, "item_id", "text").filter("text is not null").toLocalIterator():
        if words(r["text"]):
            block.append((r["item_id"], r["text"]))
        if len(block) == INDEX_ITEMS:
            yield block
            block = []
    if block:
        yield block


def indexes(docs: DataFrame, benchmark: DataFrame):
    """Broadcast indexes of all items; the space is learned once, from ``docs``."""
    space = None
    for items in _item_blocks(benchmark):
        space = learn(docs) if space is None else space
        yield docs.sparkSession.sparkContext.broadcast(Index(space, items))  # INDEX_ITEMS bounds it


def _slices(column: pa.Array, size: int = 128):
    """(first place, texts) of a column, a few at a time: split words take many times the room of a text."""
    for at in range(0, len(column), size):
        yield at, column.slice(at, size).to_pylist()


LEAK = "doc_id long, item_id long, cosine double, lcs double, answer double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    docs = columns(docs, "doc_id", "text")
    found = docs.sparkSession.createDataFrame([], LEAK)
    for shipped in indexes(docs, benchmark):

        def run(batches, shipped=shipped):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = [(ids[at + place], *hit) for at, texts in _slices(batch.column(1)) for place, *hit in shipped.value.search(texts)]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "cosine", "lcs", "answer"])
                trim()

        found = found.unionByName(docs.mapInArrow(run, LEAK))
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    kept, plain = docs, columns(docs, "doc_id", "text")
    place = docs.columns.index("text")
    for shipped in indexes(plain, benchmark):

        def run(batches, shipped=shipped):
            for batch in batches:
                held = {at + t for at, texts in _slices(batch.column(place)) for t, *_ in shipped.value.search(texts)}
                yield batch.filter(pa.array([k not in held for k in range(batch.num_rows)], pa.bool_()))
                trim()

        kept = kept.mapInArrow(run, docs.schema)
    return kept
