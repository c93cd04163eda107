"""Line and document near-duplicates against brute force."""

import hashlib
import random

import numpy as np
from storyloom.llm import hashing, line_dedup, near_dedup, queries


def edit_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]


def brute_lines(rows):
    """Dropped line numbers of each distinct (id, text)."""
    def counts(x):
        return len(x.strip()) >= 4

    order = sorted({(i is None, i or 0, hashlib.md5(t.encode()).hexdigest(), t, i) for i, t in rows if t is not None})
    seen, out = [], {}
    for _, _, _, t, i in order:
        gone = []
        for k, x in enumerate(t.split("\n")):
            if counts(x):
                if any(x == y or min(len(x), len(y)) >= 12 and edit_at_most_one(x, y) for y in seen):
                    gone.append(k)
                seen.append(x)
        out[i, t] = gone
    return out


def noisy(rng, line):
    p, c = rng.randrange(len(line) + 1), rng.choice("abéz 9")
    return rng.choice([line[:p] + c + line[p + 1:], line[:p] + c + line[p:], line[:p] + line[p + 1:], line, line[:p] + c + c + line[p + 1:]])


def line_rows():
    rng = random.Random(8)
    base = ["".join(rng.choice("aab é") for _ in range(rng.choice([3, 11, 12, 13, 14, 31, 32, 33, 90]))) for _ in range(40)]
    rows = [(i, "\n".join(noisy(rng, rng.choice(base)) for _ in range(rng.randrange(1, 9)))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "short\n}\n}\n}"), (None, "a line without an id\nshort"), rows[5], rows[5],
             (4, "another text under the same id"), (300, "aaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaa"),
             (301, "𝔸 line beyond the plane\n𝔹 line beyond the plane"), (302, "w " * 60_000), (303, "w " * 59_999 + "w"), (304, "w " * 59_999 + "v ")]
    return rows + [(400 + k, f"the same heading number {k % 10}") for k in range(60)]


def test_lines_match_brute_force(spark):
    rows = line_rows()
    want = brute_lines(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS dropped", "'x' AS content", "2 AS line")
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "dropped_"]
    assert got.count() == len(rows)
    left = sorted((str(r.doc_id), r.text) for r in got.collect())
    assert left == sorted((str(i), t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i, t])) for i, t in rows)


def test_sieves_lose_nothing():
    rng = random.Random(9)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(12, 60)))
        p = rng.randrange(len(a))
        for b in (a[:p] + "c" + a[p + 1:], a[:p] + a[p + 1:], a[:p] + "c" + a[p:]):
            if len(b) >= 12:
                for m in line_dedup.SIEVES:
                    keys = line_dedup.sieve_keys(hashing.Rolling(line_dedup.symbols(a + b)), np.array([0, len(a)]), np.array([len(a), len(b)]), m)
                    assert set(keys[0]) & set(keys[1]) - {0}, (a, b, m)


def text_of(rng, n):
    return [rng.choice(["ab", "cd", "é", "the", "of"]) + str(rng.randrange(400)) for _ in range(n)]


def brute_classes(rows, threshold=0.8):
    """Longest common subsequence of labelled five-word k-mers, over all pairs."""
    def kmers(t):
        w = (t or "").split()
        seen, out = {}, []
        for g in ([tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []):
            seen[g] = seen.get(g, 0) + 1
            out.append((g, seen[g]))
        return out

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            left = 0
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    grams = [kmers(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(grams):
        for j in range(i):
            b = grams[j]
            if a and b and len(set(a) & set(b)) >= threshold / (1 + threshold) * (len(a) + len(b)) - 1:
                common = lcs(a, b)
                if common / (len(a) + len(b) - common) >= threshold:
                    root[max(top(i), top(j))] = min(top(i), top(j))
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[top(k)] = min(ids.get(top(k), i), i)
    return sorted((str(i), str(ids.get(top(k)))) for k, (i, _) in enumerate(rows))


def doc_rows():
    rng = random.Random(10)
    rows, shared = [], text_of(rng, 60)
    for f in range(25):
        base = text_of(rng, rng.choice([8, 40, 120, 300]))
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 20])):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randrange(99))
            rows.append((len(rows), " ".join(copy)))
    rows += [(500 + k, " ".join(shared + text_of(rng, 30))) for k in range(30)]  # a passage in many texts
    loop = ["a b c d e f g " * 30, "a b c d e f g " * 30 + "h", "b c d e f g a " * 30]
    rows += [(600 + k, t) for k, t in enumerate(loop)]
    half = text_of(rng, 80)
    rows += [(610, " ".join(half)), (611, " ".join(half[40:] + half[:40]))]  # the same k-mers, another order
    rows += [(700, None), (701, ""), (702, "  \n"), (703, "one"), (704, "one\n"), (705, "two words"), (None, rows[0][1]), (None, "alone here"),
             rows[3], rows[3], (800, " ".join(text_of(rng, 30_000)))]
    return rows


def test_classes_match_brute_force(spark):
    rows = doc_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS class", "'k' AS key")
    got = near_dedup.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == brute_classes([r for r in rows])
    sizes = {}
    for r in got:
        if r.class_id is not None:
            sizes[r.class_id] = sizes.get(r.class_id, 0) + 1
    assert all(r.class_size == sizes[r.class_id] for r in got if r.class_id is not None)
    stay = near_dedup.one_of_each(df)
    assert stay.columns == df.columns
    wordless = [i for i, t in rows if not (t or "").split()]
    want = {c for _, c in brute_classes([r for r in rows]) if c != "None"}
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(want | {str(i) for i in wordless} | {"None"})


def test_crowded_buckets_are_worked_off(spark):
    """One key per text, from its first k-mers only: unrelated texts share buckets, and later leaders must find the copies."""
    rng = random.Random(11)
    bodies = [text_of(rng, 60) for _ in range(9)]
    rows = [(k, " ".join(b)) for k, b in enumerate(bodies)] + [(20 + k, " ".join([*b[:-1], "end"])) for k, b in enumerate(bodies)]
    stored = spark.createDataFrame(rows, "row long, text string")
    members = stored.selectExpr("1L AS key", "row", "xxhash64(text) AS code", "56L AS n")
    links = near_dedup.links_of(members, stored, 5, 0.8).collect()
    assert {frozenset((r.a % 20, r.b % 20)) for r in links} == {frozenset((k,)) for k in range(9)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.one_of_each(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0


def test_alignment_is_the_banded_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.permutation(40).astype(np.uint32)[:rng.integers(1, 40)]
        b = a.copy()
        for _ in range(rng.integers(0, 4)):
            b = np.insert(b, rng.integers(0, len(b) + 1), 1000 + rng.integers(0, 50))
        b = np.unique(b, return_index=True)[0][np.argsort(np.unique(b, return_index=True)[1])]
        common = len(np.intersect1d(a, b))
        want = common / (len(a) + len(b) - common)
        got = near_dedup.aligned(a, b, 0.8)
        assert (got >= 0.8) == (want >= 0.8) and (got < 0.8 or abs(got - want) < 1e-12)


def test_hot_line_query(spark):
    assert queries.op3_line_dedup(spark, "/root/testdata/sf0.001").filter("n_dropped > 0").count() > 0


def test_short_copies_are_never_missed(spark):
    rng, rows = random.Random(12), []
    for i in range(0, 3000, 2):
        n, drop = rng.choice([(9, 1), (14, 2), (24, 4)])
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        rows += [(i, " ".join(words)), (i + 1, " ".join(words[:-drop]))]  # 4 of 5, 8 of 10 and 16 of 20 k-mers
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.class_id) for r in got if r.class_id != r.doc_id - r.doc_id % 2] == []


def test_lines_of_documents_with_clashing_columns(spark):
    import corpus_pipeline
    rows = [(1, "a line that repeats here\nown line of one", "en", "s", 40, 1, "x", 5), (2, "a line that repeats here\nanother own line", "en", "s", 40, 2, "y", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _c int, _d string, dropped int")
    got = {r.doc_id: r for r in corpus_pipeline.lines_stage(spark, docs, None).collect()}
    assert got[2].text == "another own line" and got[2].n_chars == 16 and (got[2]._c, got[2]._d, got[2].dropped) == (2, "y", 6)
    assert got[1].text == rows[0][1] and list(got[1].asDict()) == docs.columns
