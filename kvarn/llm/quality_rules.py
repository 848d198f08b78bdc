"""Quality rules: text measures, and the log-likelihood ratio of hashed n-grams between a trusted and the raw corpus.

Words and pairs of words are hashed into ``BUCKETS`` features. Two multinomials with add-one smoothing are counted over
them: one over all documents, one over all trusted documents (labelled of good quality; their ids are broadcast up to
``BROADCAST_IDS`` of them and joined by a shuffle beyond). A document's ratio is the mean over its features of
log p_trusted - log p_raw; it is kept if it passes the base rules and its ratio reaches ``THRESHOLD``, whatever the
other documents are. All is built-in expressions; texts are not shuffled and a feature table of BUCKETS rows is all
that leaves the executors.

Null and empty texts have no words and fail the base rules; a null doc_id is measured like any other; repeated rows
count each time. Without trusted documents every ratio is 0 and the base rules decide.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, columns

BUCKETS, BROADCAST_IDS, THRESHOLD = 16384, 2_000_000, -0.065
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text; none for null, empty or blank."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def measured(docs: DataFrame) -> DataFrame:
    """The row as ``_row``, the base measures, and ``_hashes`` (of its words), for every row."""
    step = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.coalesce(docs["text"], F.lit("")).alias("_text"))
    step = step.withColumn("_hashes", F.transform(words(F.col("_text")), lambda w: F.xxhash64(w)))
    n = F.size("_hashes")
    window = lambda i: F.xxhash64(F.get("_hashes", i), F.get("_hashes", i + 1), F.get("_hashes", i + 2))
    none = F.array().cast("array<bigint>")
    step = step.withColumn("_windows", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(none))
    # most texts repeat no window; only the others are sorted
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    step = step.withColumn("_sorted", F.when(again, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    same = lambda x, j: F.coalesce(F.get("_sorted", j)["h"] == x["h"], F.lit(False))
    repeated = F.filter("_sorted", lambda x, j: same(x, j - 1) | same(x, j + 1))
    step = step.withColumn("_starts", F.array_sort(F.transform(repeated, lambda x: x["p"])))
    # each start covers three words, less what the start before it has covered
    covered = F.aggregate(F.transform("_starts", lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get("_starts", k - 1)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumn("_lines", lines)
    return step.select(
        "_row",
        n.cast("long").alias("n_words"),
        (F.length("_text") - F.regexp_count("_text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "_hashes",
    )


def features(hashes: Column) -> Column:
    """Bucket numbers of all words and pairs of words."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(h, F.coalesce(F.get(hashes, i + 1), F.lit(0))), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, two)


def ratios(docs: DataFrame, trusted: DataFrame, most: int = BROADCAST_IDS) -> list[float]:
    """log p_trusted - log p_raw of each bucket. ``trusted``: distinct doc_ids; they are broadcast if there are at most ``most``."""
    ids = trusted.select("doc_id", F.lit(1).alias("_trusted"))
    marked = docs.join(F.broadcast(ids) if trusted.count() <= most else ids.hint("merge"), "doc_id", "left")
    hashed = marked.select(F.coalesce("_trusted", F.lit(0)).alias("t"), F.transform(words(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w)).alias("_hashes"))
    seen = hashed.select("t", F.explode(features(F.col("_hashes"))).alias("bucket"))
    counts = seen.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("t").alias("t")).collect()  # at most BUCKETS rows
    raw, good = [1] * BUCKETS, [1] * BUCKETS
    for r in counts:
        raw[r["bucket"]] += r["n"]
        good[r["bucket"]] += r["t"]
    if sum(good) == BUCKETS:
        return [0.0] * BUCKETS
    shift = log(sum(raw)) - log(sum(good))
    return [log(g) - log(r) + shift for g, r in zip(good, raw, strict=True)]


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The distinct doc_ids labelled good."""
    return columns(labels, "doc_id", "quality").filter("quality = 1 and doc_id is not null").select("doc_id").distinct()


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The row as ``_row``, the base measures, base_failed, kept and llr of every row."""
    table = ratios(columns(docs, "doc_id", "text"), trusted_ids(labels))
    weights = F.split(F.lit(",".join(f"{x:.6g}" for x in table)), ",").cast("array<double>")  # folded to one constant
    out = measured(docs).withColumn("_features", features(F.col("_hashes")))
    total = F.aggregate("_features", F.lit(0.0), lambda a, b: a + F.get(weights, b))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("llr", F.when(F.size("_features") > 0, total / F.size("_features")).otherwise(F.lit(0.0)))
    # A filter on these must not be pushed below: it would be computed from nested copies of all expressions above.
    here = lambda c: F.when(F.monotonically_increasing_id() >= 0, c)
    return out.select(
        "_row",
        here(F.col("n_words")).alias("n_words"),
        "word_chars",
        "n_symbols",
        here(F.col("n_dup_lines")).alias("n_dup_lines"),
        here(F.col("n_repeat_words")).alias("n_repeat_words"),
        here(failed).alias("base_failed"),
        here(~failed & (F.col("llr") >= threshold)).alias("kept"),
        here(F.col("llr")).alias("llr"),
    )
