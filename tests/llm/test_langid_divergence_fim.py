"""Language identification, the divergence audit and fill-in-middle against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import divergence, fill_middle, langid, queries
from storyloom.llm.common import bounded_batches
from storyloom.session import configure
from tests.conftest import SF_MID, SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, doc_id_ int, h1 string, best string, p double, block int"


def table(spark, rows):
    """Documents with more columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", "x", 0.5, 3) for r in rows], DOCS)


# --- language identification -------------------------------------------------

PIECES = sorted({b" ", b" a", b"a", b"b", b"ab", b"ba", b"aba", b" ab", b"\xc3\xa9", b"\xc3", b"\xa9"} | {bytes([k]) for k in range(256)})


def segmentations(word):
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        if word[:k] in PIECES:
            for rest in segmentations(word[k:]):
                yield (word[:k], *rest)


def model(seed, langs=3):
    rng = np.random.default_rng(seed)
    p = rng.random((len(PIECES), langs)) ** 4 + 1e-9
    return np.log(p / p.sum(axis=0))


@pytest.mark.parametrize("piece", [3, 1 << 15])
def test_forward_sums_every_segmentation(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    log_p, number = model(1), {p: k for k, p in enumerate(PIECES)}
    words = [b" abab", b" b", b" a\xc3\xa9ba", b"aba", b" ", b" zzzab"]
    got = langid.Vocabulary(PIECES).log_probability(words, log_p)
    for word, row in zip(words, got, strict=True):
        want = np.logaddexp.reduce([sum(log_p[number[p]] for p in s) for s in segmentations(word)], axis=0)
        assert np.allclose(row, want)


def test_expected_uses_equal_the_posterior_over_segmentations():
    log_p, number = model(2), {p: k for k, p in enumerate(PIECES)}
    words, lang, times = [b" abab", b" aab\xc3\xa9", b" abab"], np.array([0, 2, 1]), np.array([2.0, 1.0, 5.0])
    want = np.zeros_like(log_p)
    for word, k, n in zip(words, lang, times, strict=True):
        ways = list(segmentations(word))
        p = np.exp([sum(log_p[number[x], k] for x in s) for s in ways])
        for s, share in zip(ways, p / p.sum(), strict=True):
            for x in s:
                want[number[x], k] += n * share
    assert np.allclose(langid.Vocabulary(PIECES).expected(words, lang, times, log_p), want)


def test_sums_too_small_for_a_double_are_taken_in_logarithms():
    log_p = np.full((len(PIECES), 2), -60.0)
    log_p[:, 1] = -5.0
    word = b" " + bytes(range(130, 200))  # one segmentation
    vocabulary = langid.Vocabulary(PIECES)
    assert np.allclose(vocabulary.log_probability([word, b" z"], log_p)[0], [-60.0 * len(word), -5.0 * len(word)])
    use = vocabulary.expected([word, b" z"], np.array([0, 0]), np.array([3.0, 1.0]), log_p)
    assert np.isclose(use.sum(), 3.0 * len(word) + 2) and use[:, 1].sum() == 0


def test_units_cover_every_letter():
    for text in ("a" * 100, "é" * 65, "x²y", "ab", "İstanbul".lower()):
        whole = b"".join(langid.units(text)).replace(b" ", b"").decode()
        assert whole == "".join(c for c in text if c.isalpha())
        found, sizes = langid.all_units([text, "b"])
        assert found == [*langid.units(text), b" b"] and sizes.tolist() == [len(langid.units(text)), 1]


def test_table_of_pieces_finds_all_and_only_pieces(monkeypatch):
    monkeypatch.setattr(langid, "TABLE", 9)  # crowded places
    v = langid.Vocabulary(PIECES)
    hit, number = v.find(np.append(v.hashes, v.hashes + np.uint64(1)))
    assert hit[:len(PIECES)].all() and not hit[len(PIECES):].any() and number.tolist() == list(range(len(PIECES)))


@pytest.fixture(scope="module")
def trained(spark):
    bounded_batches(configure(spark))
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    return docs, langid.train(docs.filter(~langid.held_out()))


def test_held_out_documents_are_identified(spark, trained):
    docs, models = trained
    got = queries.op11_langid(spark, SF_MID).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)


def test_blocks_of_languages_give_the_same_predictions(spark, trained):
    docs, models = trained
    some = docs.filter("doc_id < 120")
    blocks = langid.train(docs.filter(~langid.held_out()), block=3)
    assert [m.langs for m in blocks] == [models[0].langs[:3], models[0].langs[3:]]
    a, b = ({r.doc_id: r for r in langid.predict(some, m).collect()} for m in (models, blocks))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].lang_pred == b[k].lang_pred and math.isclose(a[k].score, b[k].score, abs_tol=1e-9)


def test_language_of_odd_rows(spark, trained):
    _, models = trained
    rows = [(1, None, "en", "s"), (2, "", None, "s"), (3, "123 _!? ²", "en", None), (4, "the the and of", None, None),
            (4, "the the and of", None, None), (None, "der die und", "de", "s"), (6, "the and of is " * 40000, "fr", "s"), (7, "x" * 300000, None, None)]
    got = langid.predict(table(spark, rows), models).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.lang_pred, r.score))
    assert by[1] == by[2] == by[3] == [("und", 0.0)]
    assert [p for p, _ in by[4]] == ["en", "en"] and by[None][0][0] == "de" and by[6][0][0] == "en" and by[7][0][0] in models[0].langs


def test_nothing_to_learn_from(spark):
    docs = table(spark, [(1, "word", None, "s"), (2, None, "en", "s")])
    models = langid.train(docs)
    assert models == []
    assert [(r.lang_pred, r.score) for r in langid.predict(docs, models).collect()] == [("und", 0.0)] * 2
    empty = docs.limit(0)
    assert langid.train(empty) == [] and langid.predict(empty, []).collect() == []


def test_ties_go_to_the_first_language(spark):
    docs = table(spark, [(1, "same words here", "b", "s"), (2, "same words here", "a", "s"), (3, "same words here", "", "s")])
    got = langid.predict(docs, langid.train(docs)).collect()
    assert {r.lang_pred for r in got} == {""} and all(math.isclose(r.score, 1 / 3) for r in got)


# --- divergence audit --------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, min_docs=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        found = [t.translate(UPPER) for t in TERM.findall(text)]
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for k, s in groups if k == lang]

        def share(count, total, size=len(kept)):
            return 1 + 10**9 * (count + 1) // (total + size)

        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {(s, t): share(counts[lang, s][t], n[s]) for s in sources for t in kept}
        all_n = sum(n.values())
        q = {t: share(sum(counts[lang, s][t] for s in sources), all_n) for t in kept}
        for s in sources:
            pairs = [(o, sum((p[s, t] - p[o, t])**2 // p[o, t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s, t] - q[t])**2 // q[t]) for t in kept if counts[lang, s][t] and p[s, t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


def random_documents(n=160, seed=3):
    rng = random.Random(seed)
    words = ["Über", "the", "THE", "naïve", "and", "x", "y_z", "日本", "a1b"] + [f"w{chr(97 + k)}" for k in range(26)]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de", None, ""])
        source = rng.choice([f"s{k}" for k in range(7)] + ["hot"] * 5 + [None])
        rows.append((i, " ".join(rng.choices(words, k=rng.randrange(0, 12))), lang, source))
    return rows + [(900, None, "en", "silent"), (901, "", "only", "a"), (902, "one two", "only", "b"), (903, "12 34", "only", "c")]


@pytest.mark.parametrize("groups,terms", [(16, 1 << 15), (2, 5), (1, 1)])
def test_cube_partitions_equal_plain_sums(spark, groups, terms):
    rows = random_documents()
    got = divergence.audit(table(spark, rows), groups_a_block=groups, terms_a_block=terms).collect()
    assert sorted(tuple(r) for r in got) == plain_audit(rows)


def test_terms_counted_in_slices_and_flushes(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(divergence, "SLICE", 7)
    monkeypatch.setattr(divergence, "FLUSH", 5)
    rows = random_documents(40)
    batch = pa.RecordBatch.from_pylist([{"lang": r[2] or "", "source": r[3] or "", "text": r[1] or ""} for r in rows])
    n, docs = Counter(), Counter()
    for out in divergence.count_terms([batch]):
        for r in out.to_pylist():
            n[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
    want, want_docs = Counter(), Counter()
    for _, text, lang, source in rows:
        found = [t.translate(UPPER) for t in TERM.findall(text or "")]
        want.update((lang or "", source or "", t) for t in found)
        want_docs.update((lang or "", source or "", t) for t in set(found))
    assert n == want and docs == want_docs


def test_audit_of_nothing_and_of_one_group(spark):
    assert divergence.audit(table(spark, []).limit(0)).collect() == []
    rows = [(i, "big text " * 50000 if not i else "big", "en", "s") for i in range(3)]
    assert [tuple(r) for r in divergence.audit(table(spark, rows)).collect()] == plain_audit(rows)


def test_shares_are_exact_beyond_doubles(spark):
    n, total, size = 9_000_000_000_000_001, 9_000_000_000_000_003, 12
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(size)).alias("p"),
                                divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert got.p == 1 + 10**9 * (n + 1) // (total + size) and got.none is None


# --- fill-in-middle ----------------------------------------------------------

def plain_units(text, unit):
    if unit == "char":
        return list(text)
    if unit == "word":
        return re.findall(r"[ \t-\r]*[^ \t-\r]+|[^ \t-\r]+", text) if text.strip(" \t\n\r\x0b\x0c") else []
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def fim_rows():
    rng = random.Random(5)
    letters = ["a", "B", " ", "\n", ".", "é", "日", "😀", "\t", "!", "<", ">", "P", "́", "\x0b"]
    rows = [(i, "".join(rng.choices(letters, k=rng.randrange(0, 60))), "en", "s") for i in range(300)]
    rows += [(1000, None, None, None), (1001, "", "", ""), (None, "no id", "x", "y"), (1002, "has <S> in it", "x", "y"),
             (1003, "é😀" * 200000, "x", "y"), (1004, "z", "x", "y"), (1004, "z", "x", "y")]
    return rows


def test_fill_middle_equals_slicing_by_code_points(spark):
    rows = fim_rows()
    got = fill_middle.transform(table(spark, rows)).withColumn("back", fill_middle.restored()).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    have = sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=key)
    assert have == sorted([(i, *plain_fim(i, t)) for i, t, *_ in rows], key=key)
    assert sorted((r.doc_id or -1, r.back) for r in got) == sorted((i or -1, t or "") for i, t, *_ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(table(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_cuts_fall_between_units(unit):
    texts = [t or "" for _, t, *_ in fim_rows()[:300]]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    rng = np.random.default_rng(1)
    drawn = rng.integers(0, 1 << 32, (2, len(texts)))
    n, a, b, before, between = fill_middle.cuts(data, offsets, drawn, unit)
    for i, text in enumerate(texts):
        parts = plain_units(text, unit)
        lead = len(text) - sum(map(len, parts)) if unit == "word" else 0  # blanks alone are no unit
        if unit == "word" and parts:
            text_units = [m.end() for m in re.finditer(r"[^ \t-\r]+", text)]
            assert n[i] == len(text_units)
            starts = [m.start() for m in re.finditer(r"[^ \t-\r]+", text)]
            edge = [0, *starts[1:], len(text)]
        else:
            assert n[i] == len(parts), (unit, text)
            edge = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(int).tolist()
        x, y = sorted(int(h[i] % (n[i] + 1)) for h in drawn)
        if lead and not parts:
            continue
        start = offsets[i]
        assert (a[i] - start, b[i] - start) == tuple(len(text[:edge[k]].encode()) for k in (x, y)), (unit, text)
        assert (before[i], between[i]) == (edge[x], edge[y] - edge[x])


def test_ranks_of_the_wavelet_matrix():
    rng = np.random.default_rng(4)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 6, size).astype(np.uint8)
        matrix = fill_middle.WaveletMatrix(symbols)
        at = np.arange(size + 1)
        for s in range(6):
            assert (matrix.rank(s, at) == np.concatenate([[0], np.cumsum(symbols == s)])).all()


def test_sentences_end_after_their_blank():
    text = "One two. Three!\nFour? five"
    data = np.frombuffer(text.encode(), np.uint8)
    n, a, b, _, _ = fill_middle.cuts(data, np.array([0, len(text)]), (np.array([1]), np.array([2])), "sentence")
    assert n[0] == 4 and text[:a[0]] == "One two. " and text[a[0]:b[0]] == "Three!\n"


def test_registered_results(spark):
    got = {r.doc_id: r for r in queries.op13_fill_middle(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n, form, prefix, middle, output = plain_fim(d.doc_id, d.text)
        r = got[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
