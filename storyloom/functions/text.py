"""Text expressions (G1–G3, G8–G14): sentence split, tokens, stop words, patterns.

Everything here is a Column expression (JVM regex, array functions) applied
per row; grouping and ranking live in ``operators.summarize``.

Java-regex notes: ``(?U)`` makes ``\\w``/``\\b``/``\\s`` Unicode-aware as in
Python 3; word runs are written ``[\\p{L}\\p{N}_]`` so the DuckDB twins can use
the very same class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's lists and patterns).
# ---------------------------------------------------------------------------

# Ukrainian stop words of the compressor (used as a set).
STOP_UK = (
    "і", "в", "на", "з", "до", "за", "під", "над", "між", "про", "для",
    "від", "при", "по", "у", "та", "або", "але", "а", "чи", "не", "ні",
    "що", "який", "яка", "яке", "які", "хто", "де", "коли", "як", "чому",
    "це", "той", "та", "те", "ті", "він", "вона", "воно", "вони", "я",
    "ти", "ми", "ви", "мій", "твій", "його", "її", "наш", "ваш", "їх",
    "є", "був", "була", "було", "були", "буде", "будуть", "мати", "має",
    "мав", "мала", "мало", "мали", "можна", "треба", "потрібно",
)
# Shorter Ukrainian list of the language module (keyword fallback; used as a set).
STOP_UK_SHORT = (
    "і", "в", "на", "з", "до", "за", "під", "над", "між", "про", "для",
    "від", "при", "по", "у", "та", "або", "але", "а", "чи", "не", "ні",
    "що", "який", "яка", "яке", "які", "хто", "де", "коли", "як", "чому",
    "це", "той", "та", "те", "ті", "він", "вона", "воно", "вони", "я",
    "ти", "ми", "ви", "мій", "твій", "його", "її", "наш", "ваш", "їх",
)
# English fallback list of the compressor.
STOP_EN = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "can", "this", "that", "these", "those",
)

SENTENCE_SPLIT = r"[.!?]+"
WORD_RUN = r"[\p{L}\p{N}_]+"
TOKEN2 = r"[\p{L}\p{N}_]{2,}"
UK_LETTERS = "[іїєґ]"
CYRILLIC_WORD = r"^[а-яіїєґ]{3,}$"
LATIN_WORD = r"^[a-z]{3,}$"

# Entity patterns, English (the reference's regexes; (?U) gives Python's Unicode \b).
EN_PATTERNS = {
    "PERSON": r"(?U)\b[A-Z][a-z]+ [A-Z][a-z]+(?:\s[A-Z][a-z]+)?\b",
    "ORG": r"(?U)\b[A-Z][a-zA-Z\s]*(?:Corp|Inc|Ltd|LLC|Company|Organization|Agency|Department|Ministry)\b",
    "GPE": r"(?U)(?:in|at|from)\s+([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)",
    "MONEY": r"(?iU)\$[\d,]+(?:\.\d{2})?(?:\s*(?:million|billion|trillion))?",
    "DATE": r"(?iU)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b",
}
# Entity patterns, Ukrainian (compressor variant).
UK_PATTERNS = {
    "PERSON": r"(?U)\b[А-ЯІЇЄҐ][а-яіїєґ]+(?:\s[А-ЯІЇЄҐ][а-яіїєґ]+){1,2}\b",
    "ORG": r"(?U)\b[А-ЯІЇЄҐ][а-яіїєґ\s]*(?:підприємство|компанія|корпорація|організація|агентство|департамент|міністерство|служба|установа|фонд|партія)\b",
    "GPE": r"(?U)(?:у|в|з|до|від)\s+([А-ЯІЇЄҐ][а-яіїєґ]+(?:\s[А-ЯІЇЄҐ][а-яіїєґ]+)?)",
    "MONEY": r"(?iU)(?:₴|грн\.?|\$|€)\s?[\d\s,]+(?:\.\d{2})?(?:\s*(?:мільйон|мільярд|трильйон|тисяч|млн|млрд))?",
    "DATE": r"(?iU)\b(?:січня|лютого|березня|квітня|травня|червня|липня|серпня|вересня|жовтня|листопада|грудня)\s+\d{1,2}(?:,?\s+\d{4})?\b",
}
# Patterns whose result is the first capture group (the reference keeps match[0]).
GROUP_ONE = {"GPE"}
ENTITY_TYPES = ("PERSON", "ORG", "GPE", "MONEY", "DATE")


def stop_array(words) -> Column:
    return F.array(*[F.lit(w) for w in sorted(set(words))])


def strip_ws(s: Column) -> Column:
    """Python ``str.strip()``: remove surrounding (Unicode) whitespace."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def sentences(text: Column, min_len: int = 20) -> Column:
    """G1: split on runs of . ! ?, strip, keep pieces longer than ``min_len``."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_SPLIT), strip_ws)
    return F.filter(parts, lambda s: F.length(s) > min_len)


def tokens(text: Column, stop_words=STOP_UK) -> Column:
    """Lower-cased words of ≥ 2 word characters minus stop words, in order."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN2), 0)
    if stop_words:
        stops = stop_array(stop_words)
        toks = F.filter(toks, lambda t: ~F.array_contains(stops, t))
    return toks


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    The optimizer inlines a projected column into every place that uses it; a
    lambda variable is never inlined, so costly expressions (regex tokenising)
    run once however often the body refers to them.
    """
    return F.transform(F.array(value), body)[0]


def ngrams12(toks: Column) -> Column:
    """Unigrams followed by bigrams of adjacent tokens (after stop-word removal)."""
    def body(t):
        n = F.size(t)
        bigrams = F.when(n > 1, F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n - 1),
                                           lambda a, b: F.concat(a, F.lit(" "), b))
                         ).otherwise(F.array().cast("array<string>"))
        return F.concat(t, bigrams)
    return let(toks, body)


def counted(ordered: Column) -> Column:
    """Distinct terms of a sorted array as structs (minus = their count below zero, term), most frequent first, ties by term."""
    def body(t):
        n = F.size(t)
        first = F.when(n > 0, F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
                       ).otherwise(F.array().cast("array<int>"))
        return let(first, lambda f: F.sort_array(F.zip_with(
            f, F.concat(F.slice(f, 2, n), F.array(n + 1)),
            lambda a, b: F.struct((a - b).cast("long").alias("minus"), F.get(t, a - 1).alias("term")))))
    return F.filter(let(ordered, body), lambda x: x["term"].isNotNull())


def word_runs(text: Column) -> Column:
    """Maximal runs of word characters (Python's ``\\b\\w+\\b`` matches)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_RUN), 0)


def latin_words(text: Column, stop_words=STOP_EN) -> Column:
    """``\\b[a-zA-Z]{3,}\\b`` over the lower-cased text = whole word runs of ≥ 3 ASCII letters."""
    runs = word_runs(F.lower(text))
    stops = stop_array(stop_words)
    return F.filter(runs, lambda w: w.rlike(LATIN_WORD) & ~F.array_contains(stops, w))


def cyrillic_words(text: Column, stop_words=STOP_UK_SHORT) -> Column:
    """Whole word runs of ≥ 3 Ukrainian letters, minus the short stop list."""
    runs = word_runs(F.lower(text))
    stops = stop_array(stop_words)
    return F.filter(runs, lambda w: w.rlike(CYRILLIC_WORD) & ~F.array_contains(stops, w))


def has_ukrainian(text: Column) -> Column:
    """Any of і ї є ґ in the lower-cased text."""
    return F.coalesce(F.lower(text).rlike(UK_LETTERS), F.lit(False))


def entities(text: Column, language: str = "en") -> Column:
    """Map type → sorted distinct matches; empty types dropped.

    The reference returns ``list(set(...))`` (arbitrary order); sorted here so
    that "first three" cuts are deterministic.
    """
    pats = UK_PATTERNS if language == "uk" else EN_PATTERNS
    t = F.coalesce(text, F.lit(""))
    entries = [F.struct(F.lit(k).alias("key"), F.sort_array(F.array_distinct(
        F.regexp_extract_all(t, F.lit(pats[k]), 1 if k in GROUP_ONE else 0))).alias("value"))
        for k in ENTITY_TYPES]
    m = F.map_from_entries(F.array(*entries))
    return F.map_filter(m, lambda k, v: F.size(v) > 0)


def entities_by_lang(text: Column, lang: Column) -> Column:
    """Ukrainian patterns for ``uk`` rows, English ones otherwise."""
    return F.when(lang == "uk", entities(text, "uk")).otherwise(entities(text, "en"))
