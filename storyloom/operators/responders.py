"""Language-model steps as table-in/table-out jobs.

No model client ships.  A step builds a prompt column, looks it up in the
response table by (task, md5 of the content), and sends only the misses to a
caller-supplied ``responder(prompts: pandas.Series) -> pandas.Series`` inside
``mapInPandas`` (one call per Arrow batch, so the caller can batch requests).
Answers are written to the response table before anything reads them, so a
retried task never needs the model again for work already answered.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

# The reference's task → model → price table (USD per 1,000 characters)
# and cache lifetime.
PRICES = (
    ("naming", "gemini-1.5-flash", 0.00015),
    ("brief", "gemini-2.5-flash", 0.001),
)
CACHE_TTL_DAYS = 7

CACHE_SCHEMA = T.StructType([
    T.StructField("task_type", T.StringType()), T.StructField("content_hash", T.StringType()),
    T.StructField("response", T.StringType()), T.StructField("cost", T.DoubleType()),
    T.StructField("cached_at", T.TimestampType()), T.StructField("expires_at", T.TimestampType()),
])

Responder = Callable[[pd.Series], pd.Series]


def price_table(spark: SparkSession) -> DataFrame:
    """Task → model, price per 1,000 characters (two rows; broadcast-sized by construction)."""
    return spark.createDataFrame(list(PRICES), "task_type string, model string, price_per_1k double")


def call_cost(chars: Column, price_per_1k: Column) -> Column:
    """Characters / 1000 × price (the reference counts prompt characters as tokens)."""
    return chars / F.lit(1000.0) * price_per_1k


def latest_entries(cache: DataFrame) -> DataFrame:
    """H8: newest entry per (task, content hash) wins."""
    return cache.groupBy("task_type", "content_hash").agg(
        F.max_by(F.struct("response", "cost", "cached_at", "expires_at"), "cached_at").alias("_e")
    ).select("task_type", "content_hash", "_e.*")


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests (task_type, content_hash, …) + cached response if unexpired."""
    live = latest_entries(cache).where(F.col("expires_at") > now).select(
        "task_type", "content_hash", F.col("response").alias("cached_response"))
    return requests.join(live, ["task_type", "content_hash"], "left").withColumn(
        "hit", F.col("cached_response").isNotNull())


def cache_put(cache: DataFrame, answers: DataFrame, now: Column, ttl_days: int = CACHE_TTL_DAYS) -> DataFrame:
    """H8: new entries get cached_at = now, expires_at = now + ttl; newest wins per key."""
    new = answers.select("task_type", "content_hash", "response", "cost",
                         now.alias("cached_at"), (now + F.make_dt_interval(days=F.lit(ttl_days))).alias("expires_at"))
    return latest_entries(cache.select(*CACHE_SCHEMA.fieldNames()).unionByName(new))


def ask(prompts: DataFrame, responder: Responder) -> DataFrame:
    """Run ``responder`` over distinct (task_type, content_hash, prompt) rows in Arrow batches."""
    schema = T.StructType([T.StructField("task_type", T.StringType()),
                           T.StructField("content_hash", T.StringType()),
                           T.StructField("prompt", T.StringType()),
                           T.StructField("response", T.StringType())])

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            out = pdf[["task_type", "content_hash", "prompt"]].copy()
            out["response"] = list(responder(pdf["prompt"].reset_index(drop=True)))
            yield out

    return prompts.select("task_type", "content_hash", "prompt").dropDuplicates(
        ["task_type", "content_hash"]).mapInPandas(run, schema)


def cached_batch(requests: DataFrame, cache: DataFrame, responder: Responder, now: Column,
                 spark: SparkSession | None = None):
    """C11: hits come from the cache; misses go to the responder once, are priced, written
    to a new cache snapshot, then joined back.  Returns (answers, new_cache)."""
    spark = spark or requests.sparkSession
    looked = cache_lookup(requests, cache, now)
    misses = looked.where(~F.col("hit"))
    answered = ask(misses, responder)
    priced = (answered.join(F.broadcast(price_table(spark)), "task_type", "left")
              .withColumn("cost", call_cost(F.length("prompt").cast("double"), F.col("price_per_1k"))))
    # Write the answers first: reruns and retried stages read them, never the model.
    priced = materialize(priced.select("task_type", "content_hash", "response", "cost"), "responses")
    new_cache = cache_put(cache, priced, now)
    answers = looked.join(priced.select("task_type", "content_hash", F.col("response").alias("new_response")),
                          ["task_type", "content_hash"], "left").select(
        *[c for c in requests.columns],
        F.coalesce("cached_response", "new_response").alias("response"), F.col("hit").alias("from_cache"))
    return answers, new_cache


# ---------------------------------------------------------------------------
# The reference's prompt texts (they feed the cost and the cache key)
# and its texts for weeks without an answer.
# ---------------------------------------------------------------------------

NAMING_HEAD = "Analyze the following news content and create a concise narrative name (2-4 words):\n\n"
NAMING_TAIL = ("\n\nGenerate a journalistic name that captures the main theme. Examples: "
               "\"Climate Policy Debate\", \"Tech Regulation Update\", \"Economic Recovery Plans\".\n\n"
               "Name (2-4 words only):")
BRIEF_HEAD = "Create a concise weekly news narrative summary:\n\nDetected Narratives ("
BRIEF_TAIL = ("\n\nWrite a 2-3 sentence summary highlighting:\n"
              "1. The main themes/topics that dominated the week\n"
              "2. Any notable narrative shifts or emerging stories\n"
              "3. Overall media focus trends\n\nWeekly Summary:")
TITLES_HEAD = ("Analyze the following news article titles and identify the main narrative theme. Generate a concise, "
               "descriptive name (2-4 words) that captures the core story or topic:\n\nArticle titles:\n")
STATEMENTS_HEAD = ("Analyze the following news statements and identify the main narrative theme. Generate a concise, "
                   "descriptive name (2-4 words) that captures the core story or topic:\n\nStatements:\n")
THEME_TAIL = ("\n\nInstructions:\n- Create a journalistic, descriptive name\n- Keep it concise (2-4 words maximum){gap}\n"
              "- Focus on the main theme, event, or topic\n"
              "- Use title case (e.g., \"Climate Policy Debate\", \"Tech Regulation Update\")\n"
              "- Do not include dates or numbers\n- Respond with ONLY the narrative name, nothing else\n\nNarrative name:")
TITLES_TAIL = THEME_TAIL.format(gap="")
STATEMENTS_TAIL = THEME_TAIL.format(gap="  ")
STATEMENTS_JOIN = "\\n"  # a backslash and an n, as the reference has it
EXTRACT_HEAD = ("Analyze the following news article and extract key statements in the format: WHO → WHAT → WHY → CONSEQUENCE."
                "\n\nArticle Title: ")
EXTRACT_CONTENT = "\nArticle Content: "
EXTRACT_SOURCE = "  # Limit content length\nSource: "
EXTRACT_TAIL = """

Instructions:
1. Extract 1-3 most important statements/claims from the article
2. For each statement, identify:
   - WHO: The actor (person, organization, government, etc.)
   - WHAT: What they said, did, or what happened
   - WHY: The reasoning, cause, or motivation (if mentioned)
   - CONSEQUENCE: Expected or stated outcome/impact (if mentioned)

3. Return ONLY a JSON array with this exact structure:
[
  {
    "actor": "WHO - clear identification of the actor",
    "action": "WHAT - the main action/statement/event",
    "reason": "WHY - reasoning or cause (empty string if not mentioned)",
    "consequence": "CONSEQUENCE - expected outcome (empty string if not mentioned)",
    "full_statement": "Complete extracted statement in natural language",
    "confidence": 0.8
  }
]

Requirements:
- Be precise and factual
- Include direct quotes when available
- Confidence score from 0.0 to 1.0
- Maximum 3 statements per article
- Return empty array if no clear statements found
- Ensure valid JSON format

JSON Response:"""
#: Characters of an article that the extraction prompt shows, of a statement that the naming prompt shows; how many items it lists.
EXTRACT_CHARS, STATEMENT_CHARS, LISTED = 3000, 200, 5
EMPTY_WEEK = "No significant narratives detected this week."
FAILED_WEEK = ("Weekly analysis completed with ", " narratives detected.")


def naming_prompt(content: Column) -> Column:
    """L1 prompt around the compressed content."""
    return F.concat(F.lit(NAMING_HEAD), content, F.lit(NAMING_TAIL))


def titles_prompt(titles: Column) -> Column:
    """L2 prompt over the first titles of a cluster."""
    lines = F.transform(F.slice(titles, 1, LISTED), lambda t: F.concat(F.lit("- "), t))
    return F.concat(F.lit(TITLES_HEAD), F.array_join(lines, "\n"), F.lit(TITLES_TAIL))


def statements_prompt(statements: Column) -> Column:
    """L2 prompt over the first statements of a cluster."""
    lines = F.transform(F.slice(statements, 1, LISTED), lambda t: F.concat(F.lit("- "), F.substring(t, 1, STATEMENT_CHARS), F.lit("...")))
    return F.concat(F.lit(STATEMENTS_HEAD), F.array_join(lines, STATEMENTS_JOIN), F.lit(STATEMENTS_TAIL))


def extract_prompt(title: Column, content: Column, source: Column) -> Column:
    """L5 prompt for one article; the cut at 3,000 characters is the reference's."""
    return F.concat(F.lit(EXTRACT_HEAD), title, F.lit(EXTRACT_CONTENT), F.substring(content, 1, EXTRACT_CHARS),
                    F.lit(EXTRACT_SOURCE), source, F.lit(EXTRACT_TAIL))


def brief_bullet(name: Column, support: Column, sources: Column, coherence: Column) -> Column:
    """L3 bullet: • name (n articles, m sources, coherence: c.cc)."""
    return F.format_string("• %s (%d articles, %d sources, coherence: %.2f)", name, support, sources, coherence)


def brief_prompt(bullets: Column, n: Column) -> Column:
    return F.concat(F.lit(BRIEF_HEAD), n.cast("string"), F.lit("):\n"), F.array_join(bullets, "\n"), F.lit(BRIEF_TAIL))


def brief_text(n: Column, response: Column) -> Column:
    """L3 answer: the stripped response, or the fixed text of an empty week or a failed call."""
    failed = F.concat(F.lit(FAILED_WEEK[0]), n.cast("string"), F.lit(FAILED_WEEK[1]))
    return (F.when(n == 0, F.lit(EMPTY_WEEK))
            .otherwise(F.coalesce(F.regexp_replace(response, r"(?U)^\s+|\s+$", ""), failed)))


def stub_brief(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in for briefs; a quarter of the calls fail (null)."""
    import hashlib

    hashes = prompts.map(lambda p: hashlib.md5(p.encode("utf-8")).hexdigest())
    return hashes.map(lambda h: None if h[0] in "0123" else f" Brief {h[:8]}\n")


def stub_statements(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in for extraction: a fenced list of one statement; every eighth answer is prose."""
    import hashlib
    import json

    def answer(p):
        h = hashlib.md5(p.encode("utf-8")).hexdigest()
        if h[0] in "01":
            return "There are no clear statements."
        item = {"actor": f"Actor {h[1:3]}", "action": f"did {h[3:9]}", "full_statement": f"Actor {h[1:3]} did {h[3:9]}",
                "confidence": int(h[9], 16) / 16}
        return "```json\n" + json.dumps([item]) + "\n```"

    return prompts.map(answer)


def stub_responder(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in used by tests: a quoted two-word name from the prompt hash."""
    import hashlib

    return prompts.map(lambda p: '"Topic ' + hashlib.md5(p.encode("utf-8")).hexdigest()[:6] + '"')
