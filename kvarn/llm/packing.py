"""Sequence packing as a cutting-stock problem, solved by column generation on a length histogram.

Documents are tokenised once. Each is cut into full sequences and one remainder; a remainder's length, rounded up to a
class of ``GRAIN`` tokens, is an item of the cutting-stock problem whose stock length is the sequence length. A linear
program over cutting patterns is solved by the revised simplex method on the driver; its columns are priced by a
knapsack dynamic program. Rounded-down patterns, and a first-fit packing of what the rounding leaves, are then dealt to
the documents by their rank within a class. The driver sees the histogram (at most ``seq_len / GRAIN`` rows) and one
count for each partition, never a document.

Null or empty texts are a document of the single end id. Null or repeated doc_ids are kept as rows of their own.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, materialise, ranked, trim

SEQ_LEN, GRAIN, END_ID = 2048, 4, 1


class FastTokenizer:
    """Ids as the ``tokenizers`` library gives them for a byte-level BPE file, by the same ranks in a faster engine.

    A text that holds a special token's string goes through ``tokenizers`` itself.
    """

    def __init__(self, spec: bytes):
        import tiktoken

        self.spec = spec
        model = json.loads(spec)
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain}
        for k, b in enumerate(b for b in range(256) if b not in shown):
            shown[b] = chr(256 + k)
        byte_of = {c: b for b, c in shown.items()}
        special = set(self.special)
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        import public_tokenizers

        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def slow(self):
        """Made when a text first needs it: workers that stay keep all that they load."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.spec.decode())

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")


_loaded: dict[int, FastTokenizer] = {}


def _tokenizer(spec: bytes) -> FastTokenizer:
    key = zlib.crc32(spec)
    if key not in _loaded:
        _loaded[key] = FastTokenizer(spec)
        trim()
    return _loaded[key]


def knapsack(weights: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over distinct weights: the best value and how often each item is taken."""
    dense = np.full(capacity + 1, -np.inf)
    dense[weights] = values
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        gain = best[c - 1 :: -1] + dense[1 : c + 1] if c > 1 else dense[1:2]
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-15:
            best[c], took[c] = gain[k], k + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(capacity + 1, dtype=np.int64), capacity
    while c > 0:
        counts[took[c]] += 1
        c -= int(took[c]) or 1
    return float(best[capacity]), counts[weights]


def invert(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivoting; no BLAS, whose threads may not survive the start of the JVM."""
    m = len(matrix)
    work = np.hstack([matrix.astype(np.float64), np.eye(m)])
    for k in range(m):
        lead = k + int(np.abs(work[k:, k]).argmax())
        if lead != k:
            work[[k, lead]] = work[[lead, k]]
        work[k] /= work[k, k]
        others = np.flatnonzero(work[:, k])
        others = others[others != k]
        work[others] -= work[others, k][:, None] * work[k]
    return work[:, m:].copy()


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", matrix, vector.astype(np.float64))


def greedy_basis(w: np.ndarray, b: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis: patterns filled by falling size, each cut until a size is used up. Later patterns lack that size, so they are triangular."""
    m = len(w)
    basis, x, left, open_ = np.zeros((m, m)), np.zeros(m), b.copy(), np.ones(m, dtype=bool)
    for k in range(m):
        column, room = np.zeros(m), capacity
        for i in range(m - 1, -1, -1):
            if open_[i] and w[i] <= room:
                n = room // int(w[i]) if column.any() else min(room // int(w[i]), max(1, int(left[i])))
                n = min(n, max(1, int(np.ceil(left[i]))))
                column[i], room = n, room - n * int(w[i])
                if not room:
                    break
        used = column > 0
        x[k] = (left[used] / column[used]).min()
        done = np.flatnonzero(used)[int(np.argmin(left[used] / column[used]))]
        left = np.maximum(left - x[k] * column, 0)
        left[done], open_[done], basis[:, k] = 0, False, column
    return basis, x


def cutting_stock(sizes: list[int], demand: list[int], capacity: int, gap: float = 5e-4, max_pivots: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is cut, meeting every demand exactly: [(items of each size, copies)].

    ``gap``: the program stops when its value is within this share of the Farley bound. The residue of rounding down is
    packed first-fit by falling size.
    """
    w, b = np.array(sizes, dtype=np.int64), np.array(demand, dtype=np.float64)
    if not len(w):
        return []
    basis, x = greedy_basis(w, b, capacity)
    inverse, bound = invert(basis), float((b * w).sum()) / capacity
    for pivot in range(max_pivots):
        dual = inverse.sum(axis=0)
        value, column = knapsack(w, dual, capacity)
        bound = max(bound, x.sum() / max(value, 1e-12))
        if value <= 1 + 1e-9 or x.sum() <= bound * (1 + gap):
            break
        direction = times(inverse, column)
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        step = ratio[leave]
        x = np.maximum(x - step * direction, 0)
        x[leave] = step
        basis[:, leave] = column
        row = inverse[leave] / direction[leave]
        inverse = inverse - direction[:, None] * row
        inverse[leave] = row
        if pivot % 200 == 199:  # against drift
            inverse = invert(basis)
            x = np.maximum(times(inverse, b), 0)
    left = np.array(demand, dtype=np.int64)
    plan: list[tuple[np.ndarray, int]] = []
    for k in np.argsort(-x):
        column = basis[:, k].astype(np.int64)
        copies = int(np.floor(x[k] + 1e-9))
        used = column > 0
        copies = min(copies, int((left[used] // column[used]).min())) if used.any() else 0
        if copies:
            plan.append((column, copies))
            left -= copies * column
    return plan + first_fit(w, left, capacity)


def first_fit(w: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Fill one sequence after another with the largest sizes that still fit, equal sequences together."""
    left, plan = left.copy(), []
    order = np.argsort(-w)
    while left.any():
        column, room = np.zeros(len(w), dtype=np.int64), capacity
        for k in order:
            if left[k] and w[k] <= room:
                n = min(int(left[k]), room // int(w[k]))
                column[k], room = n, room - n * int(w[k])
        used = column > 0
        copies = int((left[used] // column[used]).min())
        plan.append((column, copies))
        left -= copies * column
    return plan


def pieces(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens. All but a document's last piece are full."""
    with open(tokenizer_path, "rb") as f:
        spec = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast(spec)  # one file of fixed size

    def cut(batches):
        tok = _tokenizer(shipped.value)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(tok.ids(text or ""), np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), seq_len):
                    piece = ids[at : at + seq_len]
                    out.append((doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)
            del out, cols
        trim()

    return columns(docs, "doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """``pieces`` with their places: sequence_id and offset, gapless from 0 in each sequence."""
    units = seq_len // GRAIN
    kind = F.when(F.col("length") == seq_len, units + 1).otherwise(F.ceil(F.col("length") / GRAIN)).cast("int")
    found = ranked(pieces(docs, tokenizer_path, seq_len).withColumn("_kind", kind), ["_kind", "doc_id", "start"], "_rank")
    found = materialise(found, "pieces")
    hist = dict(found.groupBy("_kind").count().collect())  # at most units + 1 rows
    sizes = sorted(k for k in hist if k <= units)
    plan = cutting_stock(sizes, [hist[k] for k in sizes], units)

    base, total = {}, 0  # the first global rank of each class
    for k in sorted(hist):
        base[k] = total
        total += hist[k]
    entries, first_sequence, next_rank = [], 0, dict(base)
    for column, copies in plan:
        for k, per in zip(sizes, column.tolist(), strict=True):
            if per:
                entries.append((next_rank[k], first_sequence, per))
                next_rank[k] += per * copies
        first_sequence += copies
    if units + 1 in hist:
        entries.append((base[units + 1], first_sequence, 1))
    entries.sort()
    lows, seqs, pers = (np.array([e[i] for e in entries], dtype=np.int64) for i in range(3))

    def deal(batches):
        for batch in batches:
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            e = np.searchsorted(lows, rank, side="right") - 1
            sequence = seqs[e] + (rank - lows[e]) // pers[e] if len(rank) else rank
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence, pa.int64())], names=[*batch.schema.names, "sequence_id"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _kind int, _rank long, sequence_id long"
    dealt = found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_kind", "_rank").mapInArrow(deal, schema)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, -1)  # at most seq_len rows
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("_kind", "_rank")
