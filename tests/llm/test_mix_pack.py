"""Mixing and packing against their definitions."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from storyloom.llm import mixing, packing

SCHEMA = "doc_id long, text string, source string"


def rows():
    rng = random.Random(1)
    out = [(i, " ".join(rng.choice(["a", "bé", "c d"]) for _ in range(rng.choice([0, 1, 7, 60, 900]))), rng.choice(["s1", "s2", "S1", "é", None, "s1", "s1", "s1"]))
           for i in range(260)]
    return out + [(400, None, "s2"), (401, "", "empty"), (402, " \t\n", "empty"), (None, "one two", "s2"), (None, "one two", "s2"), out[3], out[3],
                  (403, "x\n" * 70_000, "long"), (404, "tiny", "tiny")]


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes):
    """Rounds of resharing, as the contract tells them."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
            free.discard(s)
    return target


def test_targets_and_taken(spark):
    data = rows()
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += words(t)
    want = brute_targets(sizes)
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS size", "'x' AS row", "2 AS taken", "3 AS src")
    got = mixing.taken_words(df).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), words(t)) for i, t, _ in data)
    by_size = {v: k for k, v in sizes.items()}
    taken = Counter()
    for r in got:
        s = by_size[r.source_size]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.taken_words(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_keeps_shares_in_every_prefix(spark):
    segments, documents = mixing.mix(mixing.sized(spark.createDataFrame(rows(), SCHEMA)), block_tokens=64)
    source = {r.src: r for r in documents.select("src", "source_size", "target").distinct().collect()}
    total = sum(r.target for r in source.values())
    seen, n = Counter(), 0
    blocks = defaultdict(int)
    for r in segments.orderBy("slot").collect():
        seen[r.src] += r.words
        blocks[r.slot] += r.words
        n += r.words
        for s, x in source.items():
            assert abs(seen[s] - n * x.target / total) <= 64 * 12
    assert max(blocks.values()) <= 64
    covered = defaultdict(list)
    for r in segments.collect():
        covered[r.row].append((r.skip, r.words))
    for spans in covered.values():  # at most twice over any word
        ends = sorted([(a, 1) for a, n in spans] + [(a + n, -1) for a, n in spans])
        depth = 0
        for _, d in ends:
            depth += d
            assert depth <= 2


def test_whole_documents(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS _row", "2 AS _copies", "3 AS size")
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, s in data:
        sizes[s] += words(t)
        longest[s] = max(longest[s], words(t))
    for r in got.collect():
        taken[r.source] += words(r.text)
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= longest[s] + 1 for s in sizes)
    assert max(Counter((r.doc_id, r.text) for r in got.filter("doc_id >= 0 AND doc_id <> 3").collect()).values()) <= 2


def test_empty_mix(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.taken_words(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], SCHEMA)
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.taken_words(blank).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def waste(lengths, counts, bounds):
    return sum(n * min(b - x for b in bounds if b >= x) for x, n in zip(lengths, counts, strict=True))


@pytest.mark.parametrize("buckets", [1, 2, 3, 4, 20])
def test_boundaries_are_optimal(buckets):
    rng = random.Random(buckets)
    for _ in range(25):
        lengths = sorted(rng.sample(range(1, 90), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 30) for _ in lengths]
        got = packing.best_boundaries(lengths, counts, buckets)
        best = min(waste(lengths, counts, b) for k in range(1, min(buckets, len(lengths)) + 1)
                   for b in combinations(lengths, k) if b[-1] == lengths[-1])
        assert len(got) <= buckets and waste(lengths, counts, got) == best
    assert packing.best_boundaries([], [], buckets) == []


def test_pieces_fill_batches(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS bucket", "2 AS length", "3 AS chunk")
    got = packing.pack(df, buckets=4, max_tokens=500, batch_tokens=1200).collect()
    pieces = sorted((str(i), p, p * 500, min(500, words(t) - p * 500)) for i, t, _ in data for p in range(-(-words(t) // 500)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length) for r in got) == pieces
    batches = defaultdict(list)
    for r in got:
        assert r.length <= r.padded
        batches[r.bucket, r.batch].append(r)
    for (b, n), held in batches.items():
        rows_each = 1200 // held[0].padded
        assert sorted(r.slot for r in held) == list(range(len(held)))
        assert len(held) <= rows_each and (len(held) == rows_each or (b, n + 1) not in batches)
    histogram = Counter(x for *_, x in pieces)
    lengths = sorted(histogram)
    assert {r.padded for r in got} == set(packing.best_boundaries(lengths, [histogram[x] for x in lengths], 4))
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    assert packing.pack(df.filter(F.col("doc_id") == 401)).count() == 0


def test_rows_without_an_id_spread_over_chunks(spark):
    docs = spark.createDataFrame([(None, "s", f"w{i} x") for i in range(3000)], "doc_id long, source string, text string")
    sizes = mixing.sized(docs)
    placed = mixing.streams(sizes, mixing.plan_sources(sizes, mixing.WEIGHTS, 1.5, 2.0), 7)
    assert placed.select("chunk").distinct().count() >= 4
    assert sorted(r.begin for r in placed.collect()) == list(range(0, 6000, 2))
    packed = packing.pack(docs)
    assert packed.count() == 3000 and packed.select("bucket", "batch", "slot").distinct().count() == 3000


def test_points_are_even_far_out(spark):
    """Neighbouring points of the golden ratio far beyond what doubles resolve."""
    far = spark.range(4 * 10**12, 4 * 10**12 + 1000).select((F.pmod(
        F.col("id").cast("decimal(18,0)") * F.lit(mixing.GOLDEN), F.lit(mixing.UNITS)).cast("double") / F.lit(float(mixing.UNITS))).alias("u"))
    u = sorted(r.u for r in far.collect())
    gaps = [b - a for a, b in zip(u, u[1:], strict=False)] + [u[0] + 1 - u[-1]]
    assert max(gaps) < 2 / 1000 and min(gaps) > 0.3 / 1000
