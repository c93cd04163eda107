"""Personal data by bootstrapped contextual extraction.

Seeds are the spans that exact rules find (e-mail, IPv4, card, phone).  The
words before a seed induce lexical patterns; patterns and the values seen in
them form a bipartite graph.  Spark scores it in rounds: a pattern is trusted as
far as the values it extracts are, a value as far as some pattern holding it is.
Patterns that stay above ``min_confidence`` then extract mentions the rules
miss: cards with a wrong check digit, phones without a plus, obfuscated
addresses, IPv6.  Base spans always stay; found spans never overlap them.

A pattern is one or two words left of a mention.  It needs ``min_seeds``
different seed values, and its nearest word must be a real cue: at least
``min_cue_share`` of that word's occurrences in the whole corpus stand before an
identifier.  Common words ("the 4532...") therefore never become patterns.

Text is read twice, by one task per scan split: once for spans and mentions,
once for word counts.  All later work is on the small mention table: counts are
pre-aggregated per (pattern, value, kind), joins are left to the planner, so a
hot pattern is split like any skewed join key.

Defined cases: null and empty texts have no spans; every input row gives one
result row, repeated rows and null ids included; texts are read whole; extra
columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: In the order of the contract.
KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a digit run begins, hence the look-behind: it keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Mentions that a trusted pattern may extract, by kind.
OBFUSCATED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,64}){0,8}")
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{2,39}(?![0-9A-Za-z:])")
DIGITS = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])")
#: The one or two words left of a mention are its context; a longer word is none.
CUE = 64

SPAN = "struct<kind:int,start:int,end:int>"
SCAN = f"doc_id long, spans array<{SPAN}>, mentions array<struct<kind:int,start:int,end:int,seed:boolean,value:string,cue:string,before:string>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: each @ with the run of local characters before it and a domain after it."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def is_ipv6(text: str) -> bool:
    """Eight groups of up to four digits, or fewer with one ``::`` in place of the others."""
    left, gap, right = text.partition("::")
    groups = [g for half in (left, right) if half for g in half.split(":")]
    return all(1 <= len(g) <= 4 for g in groups) and (1 <= len(groups) <= 7 if gap else len(groups) == 8)


def cues(text: str, at: int) -> list[str]:
    """The last two whole words before ``at``, nearest first; a word of more than ``CUE`` characters ends the search."""
    out = []
    while len(out) < 2:
        while at and text[at - 1].isspace():
            at -= 1
        start = at
        while start and at - start <= CUE and not text[start - 1].isspace():
            start -= 1
        if start == at or at - start > CUE:
            break
        out.append(text[start:at].lower())
        at = start
    return out


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """The rules' spans as (start, kind, end), sorted."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        parts = (m[0][: m.start(1) - 1 - m.start()], m[1], m[2], m[3])
        if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for x in parts):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds, and identifier-like strings that no base span touches, each with its context words."""
    held = [(s, k, e, True) for s, k, e in base]
    free = []
    if "@" in text or "(at)" in text or "[at]" in text:
        free += [(m.start(), 0, m.end()) for m in OBFUSCATED.finditer(text)]
    if text.count(":") > 2:
        free += [(m.start(), 1, m.end()) for m in IPV6.finditer(text) if is_ipv6(m[0])]
    for m in DIGITS.finditer(text):
        n = sum(c.isdigit() for c in m[0])
        free += [(m.start(), 2, m.end())] * (13 <= n) + [(m.start(), 3, m.end())] * (n <= 15)
    begins, ends = [], []  # the base spans, merged where they overlap
    for s, _, e in base:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            begins.append(s)
            ends.append(e)
    for s, k, e in sorted(free):
        i = bisect(begins, s)
        if not (i and ends[i - 1] > s or i < len(begins) and begins[i] < e):
            held.append((s, k, e, False))
    out = []
    for s, k, e, seed in held:
        words = cues(text, s)
        out.append({"kind": k, "start": s, "end": e, "seed": seed, "value": text[s:e].lower(),
                    "cue": words[0] if words else "", "before": words[1] if len(words) > 1 else ""})
    return out


def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to ``SCAN`` rows."""
    of = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    seen = pa.struct([*of, ("seed", pa.bool_()), ("value", pa.string()), ("cue", pa.string()), ("before", pa.string())])
    for batch in batches:
        spans, found = [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            spans.append([{"kind": k, "start": s, "end": e} for s, k, e in base])
            found.append(mentions(text or "", base))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(spans, pa.list_(of)), pa.array(found, pa.list_(seen))],
                                         names=["doc_id", "spans", "mentions"])


def count_words(batches: Iterable[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Partial counts of the lower-case words; handed on whenever ``most`` words are held."""
    held: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return rows

    for batch in batches:
        for text in batch.column("text").to_pylist():
            held.update((text or "").lower().split())
            if len(held) >= most:
                yield flush()
    if held:
        yield flush()


def trusted_patterns(seen: DataFrame, words: DataFrame, rounds: int, min_seeds: int, min_confidence: float,
                     min_cue_share: float) -> DataFrame:
    """``pattern, kind, confidence`` of the patterns that hold after the rounds of scoring.

    ``seen`` has one row per (pattern, cue, kind, value, seed) with its count ``n``.
    """
    cue = (seen.filter("pattern = cue").groupBy("cue").agg(F.sum("n").alias("before_one"))
           .filter(F.col("cue").rlike(r"\p{L}{2}"))
           .join(words.withColumnRenamed("word", "cue"), "cue", "left")
           .filter(F.col("before_one") >= min_cue_share * F.coalesce(F.col("total"), F.lit(0))))
    lexical = (seen.filter("seed").groupBy("pattern", "cue", "kind").agg(F.count(F.lit(1)).alias("seeds"))
               .filter(F.col("seeds") >= min_seeds).join(cue, "cue", "left_semi").select("pattern", "kind"))
    lexical = materialize(lexical, "pii-lexical")  # two plans read it, and below it all words are counted
    # The graph of these patterns only.  A value that is a seed of another kind counts against the pattern.
    graph = materialize(seen.join(lexical.select("pattern").distinct(), "pattern", "left_semi")
                        .select("pattern", "value", F.col("kind").alias("as_kind"), "seed"), "pii-graph")
    edges = materialize(lexical.join(graph, "pattern").groupBy("pattern", "kind", "value")
                        .agg(F.max((F.col("seed") & (F.col("kind") == F.col("as_kind"))).cast("double")).alias("own"),
                             F.max((F.col("seed") & (F.col("kind") != F.col("as_kind"))).cast("double")).alias("other")),
                        "pii-edges")
    value = F.when(F.col("own") > 0, F.lit(1.0)).when(F.col("other") > 0, F.lit(0.0))
    scored = edges.withColumn("belief", F.coalesce(value, F.lit(0.5)))
    for _ in range(rounds):
        patterns = scored.groupBy("pattern", "kind").agg((F.sum("belief") / (F.count(F.lit(1)) + 1)).alias("confidence"))
        beliefs = (edges.select("pattern", "kind", "value").join(patterns, ["pattern", "kind"])
                   .groupBy("kind", "value").agg(F.max("confidence").alias("best")))
        scored = (edges.join(beliefs, ["kind", "value"])
                  .withColumn("belief", F.coalesce(value, F.col("best"))))
        scored = materialize(scored.select("pattern", "kind", "value", "own", "other", "belief"), "pii-beliefs")
    return (scored.groupBy("pattern", "kind").agg((F.sum("belief") / (F.count(F.lit(1)) + 1)).alias("confidence"))
            .filter(F.col("confidence") >= min_confidence))


def find(docs: DataFrame, rounds: int = 3, min_seeds: int = 3, min_confidence: float = 0.7,
         min_cue_share: float = 0.3) -> DataFrame:
    """One row per document: ``doc_id, base array<span>, found array<span>``, both sorted by start and kind."""
    docs = docs.select("doc_id", "text")
    scanned = materialize(docs.mapInArrow(scan, SCAN).withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    words = (docs.select("text").mapInArrow(count_words, "word string, n long")
             .groupBy("word").agg(F.sum("n").alias("total")))
    each = (scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
            .withColumn("pattern", F.explode(F.array_distinct(F.array("cue", F.concat_ws(" ", "before", "cue"))))))
    seen = materialize(each.groupBy("pattern", "cue", "kind", "value", "seed").agg(F.count(F.lit(1)).alias("n")), "pii-seen")
    patterns = trusted_patterns(seen, words, rounds, min_seeds, min_confidence, min_cue_share)
    # A mention read by patterns of two kinds goes to the surer one.
    found = (each.filter("NOT seed").join(patterns, ["pattern", "kind"])
             .groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
             .groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found")))
    none = F.array().cast(f"array<{SPAN}>")
    return (scanned.join(found, "row", "left")
            .select("doc_id", F.col("spans").alias("base"), F.coalesce("found", none).alias("found")))
