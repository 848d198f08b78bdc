from __future__ import annotations

import collections
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvarn.llm import common, decontaminate, license_scan, ngram_join, packing, quality_bt, quality_rules, queries, sharding, suffix_tree, surrogates, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOC)


def odd(spark):
    """Null and empty texts, blank ones, a null id, repeated rows, a long text."""
    return frame(spark, [None, "", " \t\n", "word", "a b c d", "a b c d", "x " * 30000, "null id here"], [0, 1, 2, 3, 4, 4, 5, None])


def clashing(spark):
    names = ["_row", "_text", "node", "sig", "root", "bucket", "score", "n", "k", "shard", "entity"]
    return odd(spark).select("*", *[F.lit("other").alias(n) for n in names])


def prose(n, seed=0, vocabulary=3000):
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# ---- n-gram join


def sets_of(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute_components(ids, sets, percent):
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    least = {r: min(ids[k] for k in range(len(ids)) if root[k] == r) for r in set(root)}
    return {i: (len(s), least[r]) for i, s, r in zip(ids, sets, root, strict=True)}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_join_against_brute_force(spark, n, percent):
    rng, texts = random.Random(n), []
    for k in range(30):
        base = prose(rng.choice([3, 9, 25, 60, 300]), k).split()
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(9)}"
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(frame(spark, texts), n, percent).collect()}
    assert got == brute_components(list(range(len(texts))), sets_of(texts, n), percent)


def test_join_of_a_split_group(spark):
    base, texts = prose(200).split(), []
    for k in range(40):
        copy = list(base)
        copy[k] = "changed"
        texts.append(" ".join(copy))
    want = brute_components(list(range(40)), sets_of(texts, 3), 90)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(frame(spark, texts), 3, 90, group_shingles=1000).collect()}
    assert got == want


def test_join_of_a_large_group_of_several_components(spark):
    """Sets that meet but are not similar stay apart, and those that landmarks do not link are found in other blocks."""
    rng, shared, texts = random.Random(4), prose(60, 5).split(), []
    for k in range(12):
        base = [*prose(180, 50 + k).split(), *shared]
        for _ in range(8):
            copy = list(base)
            copy[rng.randrange(180)] = f"z{rng.randrange(99)}"
            texts.append(" ".join(copy))
    for k in range(150):  # every set shares its rarest words with others
        texts.append(" ".join([*shared, *prose(180, 50 + k % 12).split()[: 60 + k % 120]]))
    want = brute_components(list(range(len(texts))), sets_of(texts, 5), 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(frame(spark, texts), 5, 80, group_shingles=3000).collect()}
    assert got == want


def test_join_against_brute_force_over_many_blocks(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 13)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(docs, 5, 80).collect()}
    assert got == brute_components([i for i, _ in rows], sets_of([t for _, t in rows], 5), 80)


def test_keep_one_decides_by_row(spark):
    w, v, u = prose(60, 1), prose(60, 2), prose(60, 3)
    got = ngram_join.keep_one(frame(spark, [w, w, v, u, u, u, None, None, " "], [1, 5, 5, 7, 7, None, 8, 8, None])).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(1, w), (5, v), (7, u), (8, ""), (8, ""), (0, " ")])
    only = ngram_join.keep_one(frame(spark, [w, v], [None, None])).collect()
    assert {r["text"] for r in only} == {w, v}


def test_trie_prunes_nothing_it_should_keep():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(120)]
    sets = list({s.tobytes(): s for s in sets}.values())
    label = ngram_join.trie_components(sets, 70)
    plain = [set(s.tolist()) for s in sets]
    want = brute_components(list(range(len(sets))), plain, 70)
    assert [want[i][1] for i in range(len(sets))] == label


def test_join_odd_rows(spark):
    got = ngram_join.join_components(clashing(spark), 3, 90).collect()
    assert len(got) == 8
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert by[0] == [(0, 0)] and by[2] == [(0, 2)] and by[3] == [(1, 3)] and by[4] == [(2, 4), (2, 4)] and by[5] == [(1, 5)]
    assert ngram_join.join_components(odd(spark).limit(0), 3, 90).count() == 0
    assert sorted(r["doc_id"] or -1 for r in ngram_join.keep_one(odd(spark)).collect() if r["text"] and r["text"].strip()) == [-1, 3, 4, 5]
    assert len(ngram_join.keep_one(clashing(spark)).columns) == len(clashing(spark).columns) and ngram_join.keep_one(odd(spark).limit(0)).count() == 0


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    got = dict(common.components(chain).collect())
    assert {got[i] for i in range(51)} == {0} and got[101] == 100


def test_components_of_long_chains(spark):
    rng = random.Random(5)
    order = rng.sample(range(3000), 3000)
    far = [1, *range(2, 200), 0]  # the two least ids at the ends
    edges = [*zip(order, order[1:]), *((a + 5000, b + 5000) for a, b in zip(far, far[1:])), (9000, 9000)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(3000)} | {i + 5000: 5000 for i in range(200)} | {9000: 9000}
    with pytest.raises(RuntimeError):
        common.components(spark.createDataFrame(edges, "a long, b long"), max_rounds=2)


# ---- packing


def test_cutting_stock_meets_demand():
    rng = np.random.default_rng(2)
    sizes = np.unique(rng.integers(1, 128, 60))
    demand = rng.integers(1, 400, len(sizes))
    plan = packing.cutting_stock(sizes.tolist(), demand.tolist(), 128)
    assert (sum(c * k for c, k in plan) == demand).all() and all((c * sizes).sum() <= 128 for c, _ in plan)
    greedy = packing.first_fit(sizes, demand.copy(), 128)
    assert (sizes * demand).sum() / 128 <= sum(k for _, k in plan) <= sum(k for _, k in greedy)
    assert packing.cutting_stock([], [], 128) == []


def test_knapsack_against_plain():
    w, v = np.array([3, 4, 7]), np.array([1.0, 1.5, 2.9])
    best = [0.0] * 18
    for c in range(1, 18):
        best[c] = max([best[c - 1]] + [best[c - x] + y for x, y in zip(w, v, strict=True) if x <= c])
    got, counts = packing.knapsack(w, v, 17)
    assert math.isclose(got, best[17]) and math.isclose((counts * v).sum(), got) and (counts * w).sum() <= 17


def check_packed(packed, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    crc = lambda part: zlib.crc32(np.array(part, "<u4").tobytes())
    want = collections.Counter((s, min(2048, len(x) - s), crc(x[s : s + 2048]), len(x)) for x in ids for s in range(0, len(x), 2048))
    assert collections.Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in packed) == want
    by = collections.defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return by


def test_packing(spark, docs, rows):
    by = check_packed(packing.pack(docs, queries.tokenizer_path()).collect(), [t for _, t in rows])
    used = sum(n for own in by.values() for _, n in own)
    assert len(by) * 2048 <= used * 1.02 + 2048


def test_the_slow_tokenizer_waits_for_a_text_that_needs_it():
    with open(queries.tokenizer_path(), "rb") as f:
        tok = packing.FastTokenizer(f.read())
    assert len(tok.ids("plain words")) and "slow" not in vars(tok)
    assert len(tok.ids(f"a {tok.special[0]} b")) and "slow" in vars(tok)


def test_packing_odd_rows(spark):
    d = clashing(spark).union(clashing(spark).limit(1).withColumn("text", F.lit("see <|endoftext|> here")))
    check_packed(packing.pack(d, queries.tokenizer_path()).collect(), [r["text"] for r in d.collect()])
    assert packing.pack(odd(spark).limit(0), queries.tokenizer_path()).count() == 0


# ---- sharding


def test_sharding(spark, docs, rows):
    got = sharding.place(docs).collect()
    text = dict(rows)
    shards = collections.defaultdict(list)
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        shards[r["shard"]].append(r["slot"])
    assert set(shards) <= set(range(24)) and len(got) == len(rows)
    assert max(map(len, shards.values())) - min(len(shards.get(s, [])) for s in range(24)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_sharding_against_a_walk_of_each_key(spark, docs, rows):
    spots, owners = sharding.ring()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    place = {i: signed(spark_hash(str(i).encode(), spark_hash(b"ring"))) for i, _ in rows}
    arc = {i: int(np.searchsorted(spots, place[i], side="left")) % len(spots) for i in place}
    room = [len(rows) // sharding.SHARDS + (s < len(rows) % sharding.SHARDS) for s in range(sharding.SHARDS)]
    home, over = {}, collections.defaultdict(list)
    for i in sorted(place, key=lambda i: (arc[i], place[i], i)):
        s = int(owners[arc[i]])
        if room[s]:
            home[i], room[s] = s, room[s] - 1
        else:
            over[arc[i]].append(i)
    carried = []
    for step in range(2 * len(spots)):
        at = step % len(spots)
        carried += over.pop(at, [])
        left = []
        for i in carried:
            s = int(owners[at])
            if room[s]:
                home[i], room[s] = s, room[s] - 1
            else:
                left.append(i)
        carried = left
    assert not carried and {r["doc_id"]: r["shard"] for r in sharding.place(docs).collect()} == home


def test_bounded_loads_place_all_and_move_little():
    rng = np.random.default_rng(0)
    spots, owners = sharding.ring(5, 16)
    for counts in (rng.integers(0, 30, len(spots)), np.where(np.arange(len(spots)) == 7, 1000, 0), np.zeros(len(spots), dtype=np.int64)):
        plan, total = sharding.bounded_loads(counts, owners, 5), int(counts.sum())
        covered = sorted(x for first, n, _ in plan for x in range(first, first + n))
        assert covered == list(range(total))
        loads = np.bincount([s for _, n, s in plan for _ in range(n)], minlength=5)
        assert loads.max() - loads.min() <= 1
    assert sharding.moved_share(rng.integers(0, 5, 4000), 24) < 0.1


def test_sharding_odd_rows(spark):
    assert sharding.place(clashing(spark)).count() == 8
    assert sharding.place(odd(spark).limit(0)).count() == 0


# ---- quality


def plain_measures(text):
    w = [x.decode() for x in (text or "").encode().split()]
    n = len(w)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    covered = {i + k for i in range(n - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, sf, docs, rows):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    text = dict(rows)
    for r in quality_rules.judge(docs, labels).select("_row.doc_id", "*").collect():
        want = plain_measures(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality_rules.THRESHOLD)


def spark_hash(data: bytes, seed: int = 42) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, seed=seed)


def plain_llr(texts: dict[int, str], trusted: set[int]) -> dict[int, float]:
    """The log-likelihood ratio of hashed words and pairs of words, document by document."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    long = lambda h: (h % (1 << 64)).to_bytes(8, "little")
    grams = {}
    for i, t in texts.items():
        h = [signed(spark_hash(w)) for w in (t or "").encode().split()]
        after = [*h[1:], 0]
        grams[i] = [x % quality_rules.BUCKETS for x in h] + [signed(spark_hash(long(b), spark_hash(long(a)))) % quality_rules.BUCKETS for a, b in zip(h, after, strict=False)]
    raw, good = (collections.Counter(dict.fromkeys(range(quality_rules.BUCKETS), 1)) for _ in "ab")
    for i, g in grams.items():
        raw.update(g)
        if i in trusted:
            good.update(g)
    a, b = sum(raw.values()), sum(good.values())
    return {i: sum(math.log(good[x] / b) - math.log(raw[x] / a) for x in g) / len(g) if g else 0.0 for i, g in grams.items()}


def test_ratio_against_brute_force(spark, sf, docs, rows):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    trusted = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    want = plain_llr(dict(rows), trusted)
    got = {r["_row"]["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    assert all(math.isclose(got[i]["llr"], want[i], abs_tol=1e-4) for i in want)
    assert all(got[i]["kept"] == (not got[i]["base_failed"] and want[i] >= quality_rules.THRESHOLD) for i in want if abs(want[i] - quality_rules.THRESHOLD) > 1e-4)
    every = quality_rules.ratios(docs.select("doc_id", "text"), quality_rules.trusted_ids(labels), most=0)
    assert every == quality_rules.ratios(docs.select("doc_id", "text"), quality_rules.trusted_ids(labels))


def test_ratio_prefers_what_is_trusted(spark):
    good, bad = [prose(80, i) for i in range(40)], [prose(80, i).replace("w", "#%") for i in range(40)]
    labels = spark.createDataFrame([(i, 1 if i < 20 else 0) for i in range(80)], "doc_id long, quality int")
    got = {r["_row"]["doc_id"]: r["llr"] for r in quality_rules.judge(frame(spark, good + bad), labels).collect()}
    assert min(got[i] for i in range(40)) > max(got[i] for i in range(40, 80))


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1), (None, 1), (4, None), (4, 0)], "doc_id long, quality int")
    got = quality_rules.judge(clashing(spark), labels)
    assert got.count() == 8 and not any(r["kept"] for r in got.filter("n_words < 50").collect())
    assert {x["n_repeat_words"] for x in got.filter("n_words = 30000").collect()} == {30000}
    assert quality_rules.judge(odd(spark), labels.limit(0)).filter("llr <> 0").count() == 0
    assert quality_rules.judge(odd(spark).limit(0), labels).count() == 0


def test_bradley_terry_held_out(spark, sf, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_bt.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)


def test_bradley_terry_learns_words(spark):
    """Texts of one form that only their words tell apart, a label that contradicts another, and a doc_id of many rows."""
    rng = random.Random(3)
    texts, quality = [], []
    for i in range(400):
        good = i % 2
        texts.append(" ".join(f"{'gb'[1 - good] if rng.random() < 0.3 else 'c'}{rng.randrange(50)}w" for _ in range(80)))
        quality.append(good)
    d = frame(spark, texts)
    labels = spark.createDataFrame([(i, q) for i, q in enumerate(quality)] + [(0, 1 - quality[0]), (1, quality[1])], "doc_id long, quality int")
    got = quality_bt.classify(d, labels).filter("held_out").collect()
    assert sum(r["predicted"] == quality[r["doc_id"]] for r in got) > 0.9 * len(got)
    again = quality_bt.classify(d.repartition(7), labels.repartition(3)).collect()
    assert {(r["doc_id"], round(r["score"], 9)) for r in again} == {(r["doc_id"], round(r["score"], 9)) for r in quality_bt.classify(d, labels).collect()}
    many = frame(spark, texts[:40] * 50, [i % 40 for i in range(2000)])
    assert quality_bt.classify(many, labels, max_rows=15).count() == 2000


def test_bradley_terry_against_plain(spark):
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0.5, 1, (60, 4)), rng.normal(-0.5, 1, (50, 4))
    w = quality_bt.bradley_terry(good, bad, ridge=0.05)
    draw = np.random.default_rng(7)
    n = 60 * quality_bt.PAIRS_EACH
    diff = good[draw.integers(0, 60, n)] - bad[draw.integers(0, 50, n)]
    gradient = (diff * (1 / (1 + np.exp(diff @ w)))[:, None]).mean(axis=0) - 0.05 * w
    assert np.abs(gradient).max() < 1e-4


def test_fit_takes_all_pairs_of_all_rows(spark):
    """The gradient over every pair of a good and a bad document vanishes, however few rows are worked on at a time; the threshold is the quantile of all."""
    rng = random.Random(5)
    quality = [int(rng.random() < 0.4) for _ in range(150)]
    texts = [" ".join(f"{'gb'[1 - q] if rng.random() < 0.2 else 'c'}{rng.randrange(40)}w" for _ in range(rng.randrange(20, 60))) + "!" * rng.randrange(1, 5) for q in quality]
    mean, scale, w, at = quality_bt.fit(frame(spark, texts), spark.createDataFrame(list(enumerate(quality)), "doc_id long, quality int"), max_rows=7)
    x, y = np.array([quality_bt.features(t) for t in texts], dtype=np.float64), np.array(quality)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(scale[: quality_bt.N_FORM], np.maximum(x.std(axis=0), 1e-6)[: quality_bt.N_FORM], atol=1e-5)
    z = (x - mean) / scale
    s = z @ w
    miss = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0]))
    gradient = (miss.sum(axis=0) @ z[y == 0] - miss.sum(axis=1) @ z[y == 1]) / miss.size + quality_bt.RIDGE * w
    assert np.abs(gradient).max() < 1e-5
    assert abs(at - np.quantile(s, (y == 0).mean())) < 1e-6


def test_bradley_terry_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1), (None, 1), (4, 0)], "doc_id long, quality int")
    got = quality_bt.classify(clashing(spark), labels).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in got)
    assert {r["score"] for r in quality_bt.classify(odd(spark), labels.limit(0)).collect()} == {0.5}
    assert quality_bt.classify(odd(spark).limit(0), labels).count() == 0


# ---- licenses


def plain_scan(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))


def test_license_base(spark, docs, rows):
    extra = ["Under THE mit-license, under the MIT\nlicense.", "CC BY-NC cc by nc", "under the mit licenses", "xunder the mit license", "apache license version 2.0 and apache license version 20", "ünder the mit license under the mit license"]
    text = dict(rows) | {10_000 + i: t for i, t in enumerate(extra)}
    got = license_scan.scan(docs.unionByName(frame(spark, extra, range(10_000, 10_000 + len(extra))))).collect()
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_scan(text[r["doc_id"]]), text[r["doc_id"]][:80]
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_join_is_exact(spark):
    rng, lines = random.Random(4), []
    for _ in range(300):
        _, t = rng.choice(license_scan.TEMPLATES)
        w = [x for x in t.split() if rng.random() < rng.choice([0.7, 0.85, 1.0])] + rng.choices(["foo", "bar"], k=rng.randrange(3))
        rng.shuffle(w)
        lines.append(" ".join(w))
    texts = ["\n".join(lines[i : i + 3]) for i in range(0, 300, 3)]
    got = {(r["doc_id"], r["block"], r["lines"], r["label"], round(r["containment"], 9)) for r in license_scan.block_matches(frame(spark, texts)).collect()}
    want = set()
    for d, t in enumerate(texts):
        lines_ = t.split("\n")
        for b in range(len(lines_)):
            for n in range(1, license_scan.RUN + 1):
                own = {w for x in lines_[b : b + n] for w in x.split()}
                if b + n > len(lines_) or not all(x.split() for x in lines_[b : b + n]):
                    continue
                for label, template in license_scan.TEMPLATES:
                    full = set(template.split())
                    if len(full & own) >= license_scan.need(len(full)) and (n == 1 or len(own) <= license_scan.DILUTION * len(full)):
                        want.add((d, b, n, label, round(len(full & own) / len(full), 9)))
    assert got == want and len(want) > 50


MIT = """/*
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction.
 */"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License."""


def test_wrapped_notices_are_found(spark):
    far = "\n\n".join(MIT.split("\n"))
    long = " ".join(f"word{i}" for i in range(200))
    texts = [MIT, GPL, f"{long}\n{GPL}\n{long}", far, MIT.replace("\n * ", " "), "\n".join([long, "released under", "the MIT license", long]), long]
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan(frame(spark, texts)).collect()}
    assert "mit" in got[0] and "gpl" in got[1] and "gpl" in got[2] and got[3] == [""] and "mit" in got[4] and "mit" in got[5] and got[6] == [""]


def test_hundreds_of_templates_and_a_very_long_word(spark):
    many = [(f"l{i}", " ".join(f"t{i}x{k}" for k in range(12)) + " the license of this work") for i in range(300)]
    texts = [f"{many[i][1]} {'z' * 50}" for i in range(0, 300, 50)] + ["y" * 300_000, ("y" * 100_000 + "\n") * 3]
    got = {(r["doc_id"], r["label"]) for r in license_scan.block_matches(frame(spark, texts), many).collect()}
    assert got == {(k, f"l{i}") for k, i in enumerate(range(0, 300, 50))}


def test_license_odd_rows(spark):
    assert license_scan.scan(clashing(spark)).filter("n_base = 0 and labels = '' and score = 0").count() == 8
    assert license_scan.scan(odd(spark).limit(0)).count() == 0


# ---- surrogates

PII = "Mail anna.b-7@mail4.example.com or ANNA.B-7@mail4.example.com, call +1 (017) 555-7713, card 4539 1488 0343 6467, ip 97.51.17.173, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\". Frau Müller and Herr Karl Müller met Господин Иванов; ssn 123-45-6789, IBAN DE89 3704 0044 0532 0130 00."


def test_surrogates_keep_types(spark):
    r = surrogates.replaced(frame(spark, [PII, PII.upper(), "clean text v1.2.3 in 2024, 12 345 words"])).collect()
    by = {x["_row"]["doc_id"]: x["_text"] for x in r}
    new = by[0]
    for gone in ("anna.b-7@", "555-7713", "4539 1488", "97.51.17.173", "04dbebab", "Müller", "Иванов", "123-45-6789", "0532 0130"):
        assert gone not in new
    assert by[2] == "clean text v1.2.3 in 2024, 12 345 words"
    assert re.search(r"Frau (\w+) and Herr \w+ (\w+) met Господин [А-Яа-я]+;", new), new
    family = re.search(r"Frau (\w+) and Herr \w+ (\w+) met", new)
    assert family[1] == family[2]
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}),", new)[1].replace(" ", "")
    digits = [int(c) for c in card[::-1]]
    assert sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    mails = re.findall(r"\S+@\S+\.com", new)
    assert mails[0].lower() == mails[1].lower() and mails[1][:4].isupper()
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new) and re.search(r'token = "[0-9a-f]{40}"', new)


def test_surrogates_are_distinct_and_stable(spark):
    texts = [f"Mr. Name{chr(65 + i % 26)}{chr(97 + i // 26)} at 10.0.{i // 200}.{i % 200} or u{i}@x.example.org" for i in range(400)]
    rows = surrogates.replaced(frame(spark, texts + texts[:5])).collect()
    new = {x["_row"]["doc_id"]: x["_text"] for x in rows}
    assert all(new[400 + i] == new[i] for i in range(5))
    for pattern in (r"\d+\.\d+\.\d+\.\d+", r"\S+@\S+", r"Mr\. \w+"):
        found = [re.search(pattern, new[i])[0] for i in range(400)]
        assert len(set(found)) == len({re.search(pattern, t)[0] for t in texts})
        assert not set(found) & {re.search(pattern, t)[0] for t in texts}


def test_clashes_are_drawn_again(spark, monkeypatch):
    def few(table):
        return table.withColumn("surrogate", F.concat(F.lit("s"), (F.xxhash64("entity", "turn") % 3).cast("string"), F.when(F.col("turn") > 0, F.concat("entity", "turn")).otherwise("")))

    monkeypatch.setattr(surrogates, "drawn", few)
    got = surrogates.assigned(spark.createDataFrame([(f"e{i}@x.org",) for i in range(20)], "entity string"))
    assert got.select("surrogate").distinct().count() == 20


def test_no_format_is_exhausted(spark):
    """More phones of a short format than it has, and one family name after one title with more given names than there are."""
    phones = [f"+1 {i // 1000:01d} {i % 1000 // 10:02d} {10 + i % 10}" for i in range(9000)]
    people = [f"Mr Given{chr(97 + i % 26)}{chr(97 + i // 26)} Smith" for i in range(400)]
    got = surrogates.assigned(spark.createDataFrame([(x,) for x in phones + people], "entity string")).collect()
    assert len(got) == len(phones) + len(people) == len({r["surrogate"].lower() for r in got})
    assert not {r["surrogate"] for r in got} & {*phones, *people}
    assert len({r["surrogate"].split(" ")[-1] for r in got if r["kind"] == "person"}) == 1


def test_family_names_stay_together(spark):
    texts = [f"Mr {n} met Ms Anna {n} and Dr {n}" for n in [f"Fam{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]]
    for r in surrogates.replaced(frame(spark, texts)).collect():
        a, b, c = re.fullmatch(r"Mr (\w+) met Ms \S+ (\w+) and Dr (\w+)", r["_text"]).groups()
        assert a == b == c


def test_surrogates_against_plain(spark, docs, rows):
    """Detection and replacement by another engine of patterns, with the table of surrogates; and each surrogate's form."""
    import regex

    pattern = regex.compile(surrogates.PATTERN)
    more = [PII, *[f"Mr. Ab{chr(97 + i)} Cd{chr(97 + i % 7)} at 10.0.{i}.{i % 7}, u{i}@x{i % 3}.example.org, +44 20 {1000 + i} {2000 + i}" for i in range(26)]]
    rows = [*rows, *enumerate(more, 10_000)]
    docs = docs.unionByName(frame(spark, more, range(10_000, 10_000 + len(more))))
    found = {m[0] for _, t in rows for m in pattern.finditer(t or "")}
    table = {r["entity"]: (r["kind"], r["surrogate"]) for r in surrogates.assigned(spark.createDataFrame([(x,) for x in found], "entity string")).collect()}
    assert set(table) == found and len(found) > 50
    got = {r["_row"]["doc_id"]: r for r in surrogates.replaced(docs).collect()}
    for i, t in rows:
        assert got[i]["_text"] == (None if t is None else pattern.sub(lambda m: table[m[0]][1], t))
        assert list(got[i]["_entities"] or []) == [m[0] for m in pattern.finditer(t or "")]
    shape = lambda x: regex.sub(r"\p{Lu}", "A", regex.sub(r"\p{Ll}", "a", regex.sub("[0-9]", "0", x)))
    for entity, (kind, new) in table.items():
        assert new != entity and regex.fullmatch(surrogates.PATTERNS[kind], new), (entity, new)
        if kind in ("phone", "ssn", "iban", "card"):
            assert shape(new) == shape(entity)
        if kind == "email":
            assert new.rsplit(".", 1)[1] == entity.rsplit(".", 1)[1] and len(new) == len(entity)
        if kind == "person":
            assert new.split(" ")[0] == entity.split(" ")[0] and len(new.split(" ")) == len(entity.split(" "))
    lower = {}
    for entity, (_, new) in table.items():
        assert lower.setdefault(new.lower(), entity.lower()) == entity.lower()


def test_surrogates_odd_rows(spark):
    got = {(r["_row"]["doc_id"], r["_row"]["text"], r["_text"]) for r in surrogates.replaced(clashing(spark)).collect()}
    assert len(got) == 7 and all(a == b for _, a, b in got)
    assert surrogates.replaced(odd(spark).limit(0)).count() == 0
    assert surrogates.replaced(frame(spark, [PII] * 3, [1, 1, None])).select("_text").distinct().count() == 1


# ---- decontamination


def plant(item, filler, seed, swap=0.0):
    rng = random.Random(seed)
    words = [w if rng.random() >= swap else f"other{rng.randrange(99)}" for w in item.split()]
    f = filler.split()
    return " ".join([*f[: len(f) // 2], *words, *f[len(f) // 2 :]])


def test_leaks_are_found_and_clean_texts_left(spark):
    items = [" ".join(f"q{k}x{i}" if i % 3 else f"w{i}" for i in range(20 + 5 * k)) + "." for k in range(8)]
    bench = spark.createDataFrame([*enumerate(items), (100, None), (101, "")], "item_id long, text string")
    texts = [prose(150, i) for i in range(60)]
    held = {i: i % 8 for i in range(0, 60, 5)}
    texts = [plant(items[held[i]], t, i, 0.2 if i % 2 else 0.0).upper() if i in held else t for i, t in enumerate(texts)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame(spark, texts), bench).collect()}
    assert got == set(held.items())
    assert {r["doc_id"] for r in decontaminate.clean(frame(spark, texts), bench).collect()} == set(range(60)) - set(held)


def held_by_brute_force(index, ws) -> set[int]:
    """Items that some passage's surroundings hold, by LCS of all items with all passages."""
    found = set()
    for k, (_, pattern, tail) in enumerate(index.items):
        for s in decontaminate.passage_starts(len(ws)).tolist():
            around = ws[max(0, s - len(pattern)) : s + decontaminate.WINDOW + len(pattern)]
            share = decontaminate.common_subsequence(pattern, around) / len(pattern)
            ends = decontaminate.common_subsequence(tail, around) / len(tail) if tail else 0
            if share >= decontaminate.SURE_LCS or (share >= decontaminate.LIKELY_LCS and ends >= decontaminate.ANSWER_LCS):
                found.add(index.items[k][0])
                break
    return found


def test_recall_of_paraphrases_against_brute_force(spark, sf, docs, rows, monkeypatch):
    """Copies with words replaced by corpus words (synonyms that the benchmark does not know), dropped and put in, amid other text; a sample far smaller than the corpus, fewer dimensions than items."""
    monkeypatch.setattr(decontaminate, "SAMPLE_PASSAGES", 1500)
    monkeypatch.setattr(decontaminate, "DIMENSIONS", 32)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontaminate.Index(decontaminate.learn(docs.select("doc_id", "text")), items)
    assert len(index.items) > 32 or len(items) <= 40
    rng, texts = random.Random(6), []
    known = {w for _, ws, _ in index.items for w in ws}
    corpus = [w for _, t in rows for w in decontaminate.words(t) if w not in known] or [b"other"]
    for n in range(240):
        _, ws, tail = index.items[n % len(index.items)]
        copy, free = list(ws), range(len(ws) - (len(tail) if n % 2 else 0))
        for i in rng.sample(free, min(len(free), int((0.45 if n % 2 else 0.25) * len(ws)))):
            copy[i] = rng.choice(corpus)
        if n % 3 == 0:
            copy.insert(rng.randrange(len(copy)), rng.choice(corpus))
        pad = lambda: [rng.choice(corpus) for _ in range(rng.randrange(0, 120))]
        texts.append(b" ".join([*pad(), *copy, *pad()]).decode())
    want = {(k, i) for k, t in enumerate(texts) for i in held_by_brute_force(index, decontaminate.words(t))}
    got = {(k, i) for k, i, *_ in index.search(texts)}
    assert got <= want and len(want) >= 200
    assert len(got) >= 0.9 * len(want), (len(got), len(want))


def test_space_is_fitted_on_every_document(spark, docs, rows, monkeypatch):
    """Its leading directions hold what those of a whole decomposition hold, and no setting leaves a passage out."""
    monkeypatch.setattr(decontaminate, "SAMPLE_PASSAGES", 1)
    monkeypatch.setattr(decontaminate, "DIMENSIONS", 24)
    space = decontaminate.learn(docs.select("doc_id", "text"))
    idf = np.abs(space.rows[:-1, space.latent])  # the sketch has signs times idf
    a = np.zeros((len(rows), decontaminate.FEATURES))
    for x, (_, t) in zip(a, rows, strict=True):
        np.add.at(x, decontaminate.features(decontaminate.words(t)), 1)
    stood = a.sum(axis=0)
    assert np.allclose(idf, np.log((len(rows) + 2) / ((a > 0).sum(axis=0) + 1)), rtol=1e-5)
    a = np.log1p(a) * idf
    a /= np.maximum(np.sqrt((a * a).sum(axis=1)), 1e-9)[:, None]
    basis = np.linalg.qr(space.rows[:-1, : space.latent] / np.maximum(idf, 1e-9)[:, None])[0]
    most = (np.linalg.svd(a @ a.T, compute_uv=False, hermitian=True)[:24]).sum()
    assert space.latent == 24 and ((a @ basis) ** 2).sum() >= 0.9 * most
    assert np.abs(np.bincount(space.fill, minlength=len(stood)) / len(space.fill) - stood / stood.sum()).max() <= 2 / len(space.fill)


def test_products_take_some_documents_a_row(spark, docs, rows, monkeypatch):
    """All features in dense blocks or none: the same product with the matrix of all documents, read from far fewer rows."""
    a = np.zeros((len(rows), decontaminate.FEATURES), dtype=np.float32)
    for x, (_, t) in zip(a, rows, strict=True):
        np.add.at(x, decontaminate.features(decontaminate.words(t)), 1)
    product, seen = decontaminate._product, []
    monkeypatch.setattr(decontaminate, "_product", lambda matrix, *x: seen.append((matrix.count(), x, out := product(matrix, *x))) or out)
    for share in (0.0, 2.0):
        monkeypatch.setattr(decontaminate, "OFTEN", share)
        decontaminate.learn(docs.select("doc_id", "text"))
    assert len(seen) == 2 * decontaminate.ROUNDS
    for n, (idf, share, q), out in seen:
        assert np.allclose(share, (a > 0).mean(axis=0)) and 0 < n < len(rows) / 20
        plain = np.log1p(a) * idf
        plain /= np.maximum(np.sqrt((plain * plain).sum(axis=1)), 1e-9)[:, None]
        plain = plain.T @ (plain @ q)
        assert np.abs(out - plain).max() <= 1e-4 * np.abs(plain).max()


def test_bags_and_the_bound_on_shared_words(docs, rows, monkeypatch, spark, sf):
    texts = [None, "", *[t for _, t in rows[:200]], " . ", "a b a"]
    split = decontaminate.Split(texts)
    own, times, sizes = split.bags()
    want = [sorted(collections.Counter(split.text(k).tolist()).items()) for k in range(len(split))]
    assert list(zip(own.tolist(), times.tolist(), strict=True)) == [x for w in want for x in w]
    assert sizes.tolist() == [len(w) for w in want if w]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontaminate.Index(decontaminate.learn(docs.select("doc_id", "text")), items)
    pick = np.random.default_rng(3)
    place = np.sort(pick.choice([k for k in range(len(split)) if len(split.text(k))], 600))
    first, k = split.first[place] + pick.integers(0, np.diff(split.first)[place]), pick.integers(0, len(index.items), 600)
    first[::2] = split.first[place[::2]]
    bins = lambda ids: collections.Counter((ids & (decontaminate.BAG - 1)).tolist())
    low, high = index._around(split, place, first, k)
    for share in (0.05, 0.5):
        monkeypatch.setattr(decontaminate, "LIKELY_LCS", share)
        held = [sum(n for b, n in bins(decontaminate.features(index.items[i][1])).items() if b in bins(split.ids[x:y])) for i, x, y in zip(k, low, high, strict=True)]
        assert index._possible(split, place, first, k).tolist() == [h >= share * index.sizes[i] for h, i in zip(held, k, strict=True)]
    whole = index.search(texts)
    monkeypatch.setattr(decontaminate, "PENDING", 1)
    assert index.search(texts) == whole


def test_all_passages_are_tried(spark, docs, rows):
    """A window with the longer subsequence, but not the answer, does not hide one with the answer."""
    corpus = [w.decode() for _, t in rows for w in decontaminate.words(t)]
    pick = random.Random(9)
    words = lambda n: pick.sample(corpus, n)
    ws = [*words(19), "the", "answer", "is", "seven"]
    item = " ".join(ws[:19]) + ". The answer is seven."
    leak, other = [*ws[:4], *words(6), *ws[10:16], *words(3), *ws[19:]], [*ws[:15], *words(8)]
    texts = [" ".join(x) for x in ([*words(200), *leak, *words(200)], [*words(200), *leak, *words(200), *other, *words(200)], [*words(200), *other, *words(200)])]
    made = frame(spark, texts, [10_000, 10_001, 10_002])
    every, bench = docs.unionByName(made), spark.createDataFrame([(1, item)], "item_id long, text string")
    index = decontaminate.Index(decontaminate.learn(every.select("doc_id", "text")), [(1, item)])
    want = {10_000 + k for k, t in enumerate(texts) if held_by_brute_force(index, decontaminate.words(t))}
    assert want == {10_000, 10_001}
    assert {r["doc_id"] for r in decontaminate.leaks(every, bench).collect()} == want


def test_large_benchmarks_are_read_in_blocks(spark, sf, docs, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", 15)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == whole and whole


def test_long_texts_are_searched_in_chunks(spark, sf, docs, rows, monkeypatch):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(5).collect()]
    index = decontaminate.Index(decontaminate.learn(docs.select("doc_id", "text")), items)
    far = " ".join(t for _, t in rows if t)[:40_000]
    text = " ".join([far, items[0][1], far, items[1][1], far])
    want = {i for _, i, *_ in index.search([text])}
    monkeypatch.setattr(decontaminate, "CHUNK", 512)
    assert {i for _, i, *_ in index.search([text])} == want >= {items[0][0], items[1][0]}


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(50):
        a, b = ([rng.choice(b"abcd") for _ in range(rng.randrange(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == t[-1][-1]


def test_leaks_odd_rows(spark):
    bench = spark.createDataFrame([(1, "some item text of a benchmark that is here"), (2, None)], "item_id long, text string")
    assert decontaminate.leaks(clashing(spark), bench).count() == 0
    assert decontaminate.leaks(odd(spark).limit(0), bench).count() == 0
    assert decontaminate.leaks(odd(spark), bench.limit(0)).count() == 0
    assert decontaminate.clean(clashing(spark), bench).count() == 8


# ---- language model


def test_scores_base(spark, docs, rows):
    train, held = collections.Counter(), {}
    tokens = {d: [*(t or "").encode().lower().split(), b""] for d, t in rows}
    for d in tokens:
        held[d] = zlib.crc32(str(d).encode()) % 7 == 2
        if not held[d]:
            train.update(tokens[d])
    n, v = sum(train.values()), len(train)
    for r in suffix_tree.scores(docs).collect():
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(train[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r["score"] < 0


def plain_scores(texts, held, depth, least, divergence):
    """The model in plain Python: scores, retained contexts, and the function that predicts."""
    tokens = [[*(t or "").encode().lower().split(), b""] for t in texts]
    train = collections.Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(train.values()), len(train)
    follow = collections.defaultdict(collections.Counter)

    def contexts(ws, i):
        """The contexts of place i, the shorter ones first; from the last word backwards."""
        own = []
        for back in range(1, depth + 1):
            if i - back < -1 or train[w := ws[i - back] if i >= back else b""] < least:
                return
            own.append(w)
            yield tuple(own)

    for ws, h in zip(tokens, held, strict=True):
        for i, w in enumerate(ws):
            if not h:
                for c in contexts(ws, i):
                    follow[c][w] += 1
    kept = set()

    def predict(context, w):
        p = (train[w] + 1) / (n + v + 1)
        for k in range(1, len(context) + 1):
            if (c := context[:k]) in kept:
                p = (follow[c][w] + len(follow[c]) * p) / (sum(follow[c].values()) + len(follow[c]))
        return p

    for c in sorted(follow, key=len):
        total = sum(follow[c].values())
        if total >= least and sum(k / total * math.log(k / total / predict(c[:-1], w)) for w, k in follow[c].items()) >= divergence:
            kept.add(c)
    longest = lambda ws, i: max(contexts(ws, i), key=len, default=())
    return [sum(math.log10(predict(longest(ws, i), w)) for i, w in enumerate(ws)) for ws in tokens], kept, predict, train


@pytest.mark.parametrize(("depth", "least", "hot"), [(5, 2, 10**9), (5, 2, 40), (2, 3, 10**9), (7, 2, 300)])
def test_scores_against_plain_model(spark, monkeypatch, depth, least, hot):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the cat sat", "a dog ran off", "the cat ran", prose(3, i, 40)]) for _ in range(30)) for i in range(60)]
    texts += [None, "", "the", "unseen words only", texts[0], texts[0], "a a a a a a a a"]
    want, kept, predict, train = plain_scores(texts, [suffix_tree.is_held_out(i) for i in range(len(texts))], depth, least, 0.05)
    assert {len(c) for c in kept} == set(range(1, depth + 1))
    for c in random.Random(1).sample(sorted(kept), 30):  # every distribution adds up to 1
        assert math.isclose(sum(predict(c, w) for w in [*train, b"never seen"]), 1.0, rel_tol=1e-9)
    monkeypatch.setattr(suffix_tree, "BLOCK_DOCS", 17)
    got = {r["doc_id"]: r for r in suffix_tree.scores(frame(spark, texts), depth, least, 0.05, hot, 1).collect()}
    assert all(math.isclose(got[i]["score"], want[i], rel_tol=1e-6) for i in range(len(texts)))
    assert sum(r["score"] for r in got.values() if r["held_out"]) > sum(r["base_score"] for r in got.values() if r["held_out"])


def test_hot_contexts_change_nothing(spark, docs):
    plain, split = (sorted((r["doc_id"], round(r["score"], 3)) for r in suffix_tree.scores(docs, hot=hot, sample=16).collect()) for hot in (10**9, 400))
    assert plain == split


def test_rare_contexts_count_at_every_size(spark):
    # ten million training tokens of filler; "zig" and "zag" stand 18 times each
    rare = frame(spark, ["zig zag"] * 20, [i for i in range(100) if not suffix_tree.is_held_out(i)][:20])
    ids = [i for i in range(1000, 1100) if not suffix_tree.is_held_out(i)][:10]
    filler = frame(spark, ["x"] * 10, ids).withColumn("text", F.expr("repeat('x ', 1000000)"))
    got = {r["doc_id"]: r for r in suffix_tree.scores(rare.filter("doc_id <> 0").limit(18).unionByName(filler)).collect()}
    own = [r for r in got.values() if r["n_tokens"] == 3]
    assert len(own) == 18 and own[0]["train_tokens"] > 1e7
    # the end after "zig zag" and "zag" after "zig" are told from the context
    assert all(r["score"] > r["base_score"] + 6 for r in own)


def test_packed_numbers():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**32 - 1])
    assert (suffix_tree.unpack_numbers(suffix_tree.pack_numbers(x)) == x).all() and len(suffix_tree.unpack_numbers(b"")) == 0


def test_scores_odd_rows(spark):
    got = suffix_tree.scores(clashing(spark)).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 1, 2, 4, 5, 5, 30001] and all(math.isfinite(r["score"]) for r in got)
    assert suffix_tree.scores(odd(spark).limit(0)).count() == 0


# ---- WARC


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(30)
    got = warc.derive(pages).collect()
    assert len(got) == 3 * pages.count()
    back = warc.parse(b"".join(bytes(r["record"]) for r in got))
    assert len(back) == len(got)
    ids = {h["WARC-Record-ID"] for h, _ in back if h["WARC-Type"] == "response"}
    for h, block in back:
        assert h["WARC-Block-Digest"] == warc.digest(block)
        if h["WARC-Type"] != "response":
            assert h["WARC-Refers-To"] in ids and h["WARC-Target-URI"] == h["WARC-Refers-To-Target-URI"]
        if h["WARC-Type"] == "metadata":
            assert json.loads(block)["Envelope"]["WARC-Header-Metadata"]["WARC-Record-ID"] == h["WARC-Refers-To"]


def test_warc_text_and_links():
    page = '<html lang="DE"><head><title>A &amp; B</title><script>var x="<p>"</script></head><body><p>Hi&nbsp;<b>you</b></p><!-- no --><a href="/x?a=1&amp;b=2">go</a><img src=pic.png></body></html>'
    assert warc.text_of(page).split() == ["Hi", "you", "go"]
    assert [x["url"] for x in warc.links_of(page, "http://e.com/d/")] == ["http://e.com/x?a=1&b=2", "http://e.com/d/pic.png"]
    headers, block = warc.response(1, "http://e.com/", page)
    _, (kind, _, body) = warc.derivatives(dict(headers), block)
    found = json.loads(body)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert kind == "metadata" and found["HTML-Metadata"]["Title"] == "A & B" and found["HTML-Metadata"]["Language"] == "de" and found["Headers"]["Content-Type"].startswith("text/html")


@pytest.mark.parametrize("piece", ["<script>", "<title>", "<!--", "<", "<a ", '<a href="', "<template>", "</", "&nbsp;", "<a href=x>", "<img src='", " ", "=", "a=\"b' "])
def test_open_html_is_read_in_linear_time(piece):
    import time

    took = []
    for n in (20_000, 80_000):
        start = time.process_time()
        warc.scan("<p>a</p>" + piece * n)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 0.3


def test_open_html_shows_no_source():
    assert warc.text_of("<p>a</p><script>var x=1;") == "a" and warc.text_of("<p>a</p><style>p {}") == "a" and warc.text_of("<p>a<!-- x") == "a"
    assert warc.text_of("<head><title>t</title><p>body without an end of the head") == "body without an end of the head"
    assert warc.text_of("a < b and c > d") == "a < b and c > d" and warc.text_of("1 <2") == "1 <2" and warc.text_of("x <b") == "x <b"
    assert warc.text_of("<template>no<p>no</template><noscript>no</noscript>yes") == "yes"
    assert warc.scan("<title>one</title><title>two</title>").title == "one" and warc.scan("<SCRIPT>x</SCRIPT >y").text == "y"


def test_long_pages(spark):
    d = spark.createDataFrame([(i, "http://e.com", "<p>" + "word " * 400_000) for i in range(6)], "page_id long, url string, html string")
    assert warc.derive(d).filter("record_type = 'conversion' and length(block) > 1000000").count() == 6


def test_visible_text_against_the_standard_parser(spark, sf):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.hidden, self.links = [], 0, 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "head", "template", "noscript", "title")
            self.links += tag in warc._LINKS and warc._LINKS[tag] in dict(attrs)
            self.out.append("\n" if tag in warc._BREAKS else "")

        def handle_startendtag(self, tag, attrs):
            self.links += tag in warc._LINKS and warc._LINKS[tag] in dict(attrs)
            self.out.append("\n" if tag in warc._BREAKS else "")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "head", "template", "noscript", "title")
            self.out.append("\n" if tag in warc._BREAKS else "")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    same = n = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").filter("html is not null").collect():
        plain = Plain()
        plain.feed(r["html"])
        plain.close()
        n += 1
        page = warc.scan(r["html"])
        same += page.text.split() == "".join(plain.out).split() and len(page.links) == plain.links
    assert n and same >= 0.97 * n, (same, n)  # what is left open is read otherwise


def test_warc_files(spark, tmp_path):
    import gzip

    records = [warc.serialise(*warc.response(i, f"http://e.com/{i}", f"<p>{i}</p>")) for i in range(3)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "c.warc").write_bytes(records[0] + records[1][:-30])
    got = warc.read(spark, str(tmp_path)).groupBy("path").count().collect()
    assert sorted(r["count"] for r in got) == [1, 3, 3]


def test_warc_odd_rows(spark):
    d = spark.createDataFrame([(1, None, None, "x"), (None, "", "", "x"), (2, "http://e.com", "no tags", "x"), (2, "http://e.com", "no tags", "x")], "page_id long, url string, html string, record string")
    got = warc.derive(d).collect()
    assert len(got) == 12 and len({r["record_id"] for r in got}) == 9
    assert warc.derive(d.limit(0)).count() == 0


# ---- pipeline


def test_pipeline_against_single_stages(spark, sf, docs):
    import corpus_pipeline

    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = [r["_row"] for r in quality_rules.judge(docs, labels).filter("kept").collect()]
    ids = [r["doc_id"] for r in kept]
    least = brute_components(ids, sets_of([r["text"] for r in kept], 5), 80)
    one = [r for r in kept if least[r["doc_id"]][1] == r["doc_id"]]
    items = [" ".join(r["text"].lower().split()) for r in bench.collect()]
    leaked = {r["doc_id"] for r in one if any(i in " ".join(r["text"].lower().split()) for i in items)}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in one} - leaked
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
    by = collections.defaultdict(int)
    for r in got:
        by[r["doc_id"]] += r["length"]
    assert all(by[r["doc_id"]] == r["doc_tokens"] for r in got)


def test_pipeline_stage_learns_from_every_document(spark, sf, docs, monkeypatch):
    seen, learn = [], decontaminate.learn
    monkeypatch.setattr(decontaminate, "learn", lambda d: seen.append(learn(d)) or seen[-1])
    queries.stage_decontaminate(spark, docs, sf)
    monkeypatch.setattr(decontaminate, "SAMPLE_PASSAGES", 1)
    queries.stage_decontaminate(spark, docs.repartition(3), sf)
    assert np.allclose(seen[0].rows[:, -decontaminate.SKETCH :], seen[1].rows[:, -decontaminate.SKETCH :])
    assert seen[0].latent == seen[1].latent and (seen[0].fill == seen[1].fill).all()


def test_pipeline_odd_rows(spark, sf, docs, tmp_path):
    """Null ids and texts, repeated ids with the same and with other texts, columns with clashing names, and an empty table."""
    import corpus_pipeline

    good = [r for r in docs.join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id"), "doc_id").select("doc_id", "text").orderBy("doc_id").limit(60).collect() if r["text"] and len(r["text"].split()) > 80]
    one, two, three, four = (g["text"] for g in good[:4])
    rows = [(900_001, one), (900_001, one), (900_001, two), (None, three), (None, None), (900_002, None), (900_003, ""), (900_004, " \n"), (900_005, f"{four} Mail anna.b@mail.example.com or 97.51.17.173."), (900_006, "z" * 200_000)]
    made = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC)
    clash = made.select("*", *[F.lit("other").alias(n) for n in ("_row", "_text", "node", "kept", "_kvarn_turn", "rank", "root")])
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:  # each stage alone takes them all and gives the same columns back
        out = stage(spark, clash, str(tmp_path))
        assert out.columns == clash.columns, name
        assert stage(spark, clash.limit(0), str(tmp_path)).count() == 0
        out.collect()
    made.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= {900_001, None, 900_005}
    texts = corpus_pipeline.STAGES[1][1](spark, made, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in texts if r["text"] and r["text"].strip()) == sorted([(900_001, one), (900_001, two), (0, three), (900_005, rows[8][1]), (900_006, "z" * 200_000)])
    hidden = corpus_pipeline.STAGES[3][1](spark, made, str(tmp_path)).filter("doc_id = 900005").first()["text"]
    assert "anna.b@" not in hidden and "97.51.17.173" not in hidden and hidden.startswith(four[:40])
