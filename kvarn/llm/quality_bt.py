"""Quality scores learned from preference pairs (Bradley-Terry) on text features.

A document's score is linear in features of its text: hashed words and pairs of words (which of them it has, in
``HASHED`` buckets each) and measures of its form. P(i preferred to j) is the logistic function of the difference of
their scores. Every labelled good document of the training rows is paired with every bad one, none is left out: the loss of a pair depends on the two
scores alone, so sums over all pairs follow from how many good and bad rows stand at each score (``KNOTS`` points of a grid, a row shared by the two points beside it).
The features of the labelled rows are written once. A step of the fit reads them twice: for the scores' counts, then for the gradient and curvature. Scoring covers every document in one pass without a shuffle.
The threshold is the quantile of all training scores that leaves the share of bad labels below it; a score of 0.5 stands there.

Null and empty texts have the features of no words. A null doc_id is scored like any other; one that is labelled both ways is
left out of the fit, one labelled twice alike counts once; documents of the same doc_id all count.
Without both labels in training, every score is 0.5.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, discard, materialise, trim
from .quality_rules import BROADCAST_IDS

MAX_ROWS, PAIRS_EACH, RIDGE, ROUNDS = 4000, 8, 1e-3, 200
KNOTS, LEVELS, SUMS, NEAR, STILL = 1 << 15, 256, 4, 10_000, 1e-8
HASHED = 512
SYMBOLS, CAPITALS, DIGITS, MARKS = b"#*$%&|<>@_{}[]=~^\\", bytes(range(65, 91)), b"0123456789", b"!?"


def form(text: str | None) -> tuple[list[float], list[bytes]]:
    """Measures of a text's form, and its words in lower case."""
    raw = (text or "").encode()
    words, size = raw.split(), max(1, len(raw))
    n = max(1, len(words))
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / size
    low = [w.lower() for w in words]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = list(zip(low, low[1:], low[2:], strict=False))
    distinct = len(set(low))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    bare = sum(1 for w in words if not w[:1].isalnum() and w[:1] < b"\x80")
    return [
        np.log1p(len(words)),
        np.log1p(len(words)) ** 2 / 10,
        lengths.mean() / 10,
        lengths.std() / 10,
        share(SYMBOLS) ** 0.5,
        share(CAPITALS) ** 0.5,
        share(DIGITS) ** 0.5,
        (raw.count(b"!") / n) ** 0.5,
        (raw.count(b".") / n) ** 0.5,
        (raw.count(b",") / n) ** 0.5,
        distinct / n,
        np.log1p(distinct) / np.log1p(n) if words else 0.0,
        1 - len(set(triples)) / max(1, len(triples)) if triples else 0.0,
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        (bare / n) ** 0.5,
        len(lines) / n,
        1.0 if not words else 0.0,
    ], low


N_FORM = len(form("")[0])


def features(text: str | None) -> np.ndarray:
    """Measures of form, then the hashed words, then the hashed pairs of words, each kind of length one."""
    out = np.zeros(N_FORM + 2 * HASHED, dtype=np.float32)
    out[:N_FORM], low = form(text)
    for k, grams in enumerate((set(low), {a + b" " + b for a, b in zip(low, low[1:], strict=False)})):
        if grams:
            count = np.bincount(np.fromiter((zlib.crc32(g) % HASHED for g in grams), dtype=np.int64, count=len(grams)), minlength=HASHED)
            at = N_FORM + k * HASHED
            out[at : at + HASHED] = count / np.sqrt((count * count).sum())
    return out


def _rows(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float32).reshape(len(texts), N_FORM + 2 * HASHED)


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs_each: int = PAIRS_EACH, ridge: float = RIDGE, seed: int = 7) -> np.ndarray:
    """Weights that maximise the likelihood of good over bad on drawn pairs' feature differences, by accelerated gradient steps: for rows in memory;
    ``fit`` takes all pairs. A pair's difference is never formed: its part of the gradient is a weight on both rows."""
    rng = np.random.default_rng(seed)
    n = max(len(good), len(bad)) * pairs_each
    better, worse = rng.integers(0, len(good), n), rng.integers(0, len(bad), n)
    # the logistic loss bends by a quarter of the mean squared length of the differences at most
    reach = 2 * ((good * good).sum(axis=1).mean() + (bad * bad).sum(axis=1).mean())
    step = 1 / (reach / 4 + ridge)
    w = ahead = np.zeros(good.shape[1])
    for turn in range(ROUNDS):
        gap = np.einsum("ij,j->i", good, ahead)[better] - np.einsum("ij,j->i", bad, ahead)[worse]
        miss = 1 / (1 + np.exp(np.clip(gap, -30, 30)))
        gradient = np.einsum("ij,i->j", good, np.bincount(better, miss, len(good))) - np.einsum("ij,i->j", bad, np.bincount(worse, miss, len(bad)))
        new = ahead + step * (gradient / n - ridge * ahead)
        w, ahead = new, new + turn / (turn + 3) * (new - w)
    return w


def _added(rows: DataFrame, part, max_rows: int) -> np.ndarray:
    """The sum of ``part(y, x)`` over all rows, ``max_rows`` at a time: one vector from each task, added by a few tasks and then here."""

    def run(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, max_rows):
                some = batch.slice(at, max_rows)
                x = np.frombuffer(b"".join(some.column(1).to_pylist()), dtype=np.float32).reshape(some.num_rows, -1).astype(np.float64)
                new = part(some.column(0).to_numpy(), x)
                total = new if total is None else np.add(total, new, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])
        trim()

    def add(batches):
        total = None
        for batch in batches:
            for p in batch.column(0):
                new = np.frombuffer(p.as_buffer())
                total = new.copy() if total is None else np.add(total, new, out=total)
        for at in range(0, 0 if total is None else len(total), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total[at : at + (1 << 16)].tobytes()], pa.binary())], names=["at", "part"])

    parts = materialise(rows.mapInArrow(run, "part binary"), "parts")
    found: dict[int, np.ndarray] = {}
    for at, p in parts.coalesce(SUMS).mapInArrow(add, "at long, part binary").toLocalIterator():
        found[at] = np.frombuffer(p) + found.get(at, 0.0)
    discard(parts)
    return np.concatenate([found[at] for at in sorted(found)]) if found else np.zeros(0)


def _over(counts: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """At each knot u, the sum over knots v of counts[v] * kernel(u - v)."""
    size = 4 * len(counts)
    return np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(kernel, size), size)[len(counts) - 1 : 2 * len(counts) - 1]


def _solve(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The solution of hx = g by conjugate gradients, h scaled by its diagonal."""
    scale = 1 / np.sqrt(np.maximum(np.diag(h), 1e-12))
    x, r = np.zeros(len(g)), g * scale
    p, size = r.copy(), r @ r
    least = 1e-20 * size
    for _ in range(2 * len(g)):
        if size <= least:
            break
        hp = scale * np.einsum("ij,j->i", h, scale * p)
        bend = p @ hp
        if bend <= 0:
            break
        x += size / bend * p
        r -= size / bend * hp
        before, size = size, r @ r
        p = r + size / before * p
    return x * scale if x.any() else g


def _all_pairs(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, n: np.ndarray, max_rows: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights that maximise the mean log likelihood of all pairs of a good and a bad row, less the ridge: Newton steps, halved where the loss grows."""
    dims, pairs = len(mean), float(n[0] * n[1])
    far = rows.mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([pa.array([max((float(np.sqrt((((np.frombuffer(x, np.float32) - mean) / scale) ** 2).sum())) for x in b.column(1).to_pylist()), default=0.0)])], names=["far"]) for b in batches),
        "far double",
    ).agg(F.max("far")).first()[0]
    w, before, least = np.zeros(dims), np.zeros(dims), np.inf
    for _ in range(ROUNDS):
        reach = far * float(np.sqrt(w @ w)) * 1.001 + 1e-3  # no score lies beyond
        step = 2 * reach / (KNOTS - 1)

        def stand(y, x, w=w, reach=reach, step=step):
            at = (((x - mean) / scale) @ w + reach) / step
            low = np.clip(at.astype(np.int64), 0, KNOTS - 2)
            out = np.zeros((2, KNOTS))
            for label in (0, 1):
                own, rest = low[y == label], (at - low)[y == label]
                out[label] = np.bincount(own, 1 - rest, KNOTS) + np.bincount(own + 1, rest, KNOTS)
            return out.ravel()

        bad, good = _added(rows, stand, max_rows).reshape(2, KNOTS)
        gap = np.arange(1 - KNOTS, KNOTS) * step
        up = 1 / (1 + np.exp(-np.clip(gap, -700, 700)))
        loss = float((good * _over(bad, np.logaddexp(0, -gap))).sum()) / pairs + ridge / 2 * float(w @ w)
        if loss > least + 1e-6 * abs(least):
            w = (w + before) / 2
            continue
        least, before = loss, w
        miss = _over(good, up) / pairs, _over(bad, up[::-1]) / pairs  # of a bad and of a good row, by its score
        bend = _over(good, up * up[::-1]) / pairs, _over(bad, up * up[::-1]) / pairs
        held = np.flatnonzero(good + bad > 0)
        low, wide = held[0], max(1, held[-1] + 1 - held[0])

        def slopes(y, x, w=w, reach=reach, step=step, miss=miss, bend=bend, low=low, wide=wide):
            z = (x - mean) / scale
            s = z @ w
            at = np.clip((s + reach) / step, 0, KNOTS - 1)
            knots = np.arange(KNOTS)
            m, a = (np.where(y == 1, np.interp(at, knots, t[1]), np.interp(at, knots, t[0])) for t in (miss, bend))
            level = np.clip((at - low) / wide * LEVELS, 0, LEVELS - 1).astype(np.int64) + LEVELS * (y == 1)
            there = np.zeros((2 * LEVELS, len(y)))
            there[level, np.arange(len(y))] = 1
            return np.concatenate([np.where(y == 1, -m, m) @ z, ((z * a[:, None]).T @ z).ravel(), (there @ z).ravel(), there.sum(axis=1), there @ s])

        found = _added(rows, slopes, max_rows)
        gradient, h, sums, count, total = np.split(found, np.cumsum([dims, dims * dims, 2 * LEVELS * dims, 2 * LEVELS]))
        gradient = gradient + ridge * w
        if np.abs(gradient).max() < STILL:
            break
        sums, middle = sums.reshape(2, LEVELS, dims), (total / np.maximum(count, 1)).reshape(2, LEVELS)
        p = 1 / (1 + np.exp(-np.clip(middle[1][:, None] - middle[0], -700, 700)))
        cross = np.einsum("ui,uj->ij", sums[1], np.einsum("uv,vj->uj", p * (1 - p) / pairs, sums[0]))
        h = h.reshape(dims, dims) - cross - cross.T
        h[np.diag_indices(dims)] += ridge
        w = w - _solve(h, gradient)
    else:
        raise RuntimeError(f"quality_bt: the fit still moves after {ROUNDS} steps")
    return w


def _quantile(scores: DataFrame, share: float) -> float:
    """The quantile of column s over all rows, between two neighbours in proportion: ranges are narrowed until few values are left."""
    n, low, high = scores.agg(F.count("*"), F.min("s"), F.max("s")).first()
    at = share * (n - 1)
    found = []
    for rank in (int(at), min(int(at) + 1, n - 1)):
        a, b, skip = low, high, 0  # the value of that rank lies in [a, b]; ``skip`` rows lie below a
        while True:
            within = scores.filter((F.col("s") >= a) & (F.col("s") <= b))
            held = within.groupBy("s").count().orderBy("s").limit(NEAR + 1).collect()
            if len(held) <= NEAR:
                break
            wide = (b - a) / 1024
            bins = {r[0]: r[1:] for r in within.groupBy(F.least(F.floor((F.col("s") - a) / wide), F.lit(1023)).alias("k")).agg(F.count("*"), F.min("s"), F.max("s")).collect()}
            for k in sorted(bins):
                count, a, b = bins[k]
                if skip + count > rank:
                    break
                skip += count
        for r in held:
            skip += r["count"]
            if skip > rank:
                found.append(r["s"])
                break
    return found[0] + (found[1] - found[0]) * (at - int(at))


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """(mean, scale, weights, threshold) from all the labelled documents given; None without both labels. ``max_rows`` are worked on at a time."""
    lab = columns(labels, "doc_id", "quality").filter("quality in (0, 1) and doc_id is not null")
    lab = lab.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).filter("quality = _most").select("doc_id", "quality")
    texts = columns(documents, "doc_id", "text").join(F.broadcast(lab) if lab.count() <= BROADCAST_IDS else lab.hint("merge"), "doc_id")

    def prepare(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, max_rows):
                some = batch.slice(at, max_rows)
                x = _rows(some.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(1).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])
        trim()

    rows = materialise(texts.select("text", "quality").mapInArrow(prepare, "y int, x binary"), "features")
    sums = _added(rows, lambda y, x: np.concatenate([[(y == 0).sum(), (y == 1).sum()], x.sum(axis=0), (x * x).sum(axis=0)]), max_rows)
    if not len(sums) or not sums[:2].all():
        discard(rows)
        return None
    n, (mean, squares) = sums[:2], sums[2:].reshape(2, -1) / sums[:2].sum()
    scale = np.maximum(np.sqrt(np.maximum(squares - mean * mean, 0)), 1e-6)
    scale[N_FORM:] = 1 / np.sqrt(N_FORM)  # hashed features keep their proportions; all of a kind weigh as much as the measures of form
    w = _all_pairs(rows, mean, scale, n, max_rows)

    def scored(batches):
        for batch in batches:
            z = (np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(batch.num_rows, -1) - mean) / scale
            yield pa.RecordBatch.from_arrays([pa.array(np.einsum("ij,j->i", z, w), pa.float64())], names=["s"])

    scores = materialise(rows.mapInArrow(scored, "s double"), "scores")
    model = mean, scale, w, _quantile(scores, float(n[0] / n.sum()))
    discard(scores)
    discard(rows)
    return model


def score(documents: DataFrame, model) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches):
        for batch in batches:
            if model is None:
                s = np.full(batch.num_rows, 0.5)
            else:
                mean, scale, w, at = model
                z = (_rows(batch.column(1).to_pylist()) - mean) / scale
                s = 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", z, w) - at, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return columns(documents, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    train = columns(labels, "doc_id", "quality").filter(~held_out(F.col("doc_id")))
    scored = score(documents, fit(documents, train, max_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
