"""Statement extraction output handling.

Model answers are a table ``(article_id, response)``; parsing is built-in JSON
functions, so any number of answers is one projection + explode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import now_col
from ..sources.tables import read_table

# The reference's field rules.
ACTOR_MAX = 300
MIN_CONFIDENCE = 0.5


def clean_json(response):
    """H5 first half: trim; drop a leading ```json fence and a trailing ``` fence; trim."""
    t = F.regexp_replace(response, r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, r"^```json", "")
    t = F.regexp_replace(t, r"```$", "")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def json_list(text):
    """The text as a variant if it is one JSON list and nothing else, else null.

    The parser reads one value and ignores what follows, so the text is parsed
    inside a list and inside an object: no trailing text survives both.
    """
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    value = F.try_variant_get(in_object, "$.x", "variant")
    return F.when(in_list.isNotNull() & F.schema_of_variant(value).startswith("ARRAY"), value)


def parse_statements(answers: DataFrame, key_cols=("article_id",)) -> DataFrame:
    """H5 + H6: JSON list → one row per valid item.

    Anything that is not strictly one JSON list gives no rows (a lone object,
    single quotes, trailing text); elements that are no objects, or lack actor or
    action, are dropped alone; actor cut to 300; missing text fields → ''; missing
    confidence → 0, null or unreadable confidence → item dropped.
    Output: keys…, item_pos, actor, action, reason, consequence, full_statement, confidence.
    """
    keys = list(key_cols)
    items = F.try_variant_get(json_list(clean_json(F.col("response"))), "$", "array<variant>")
    ex = (answers.select(*keys, F.posexplode(items).alias("item_pos", "it"))
          .where(F.schema_of_variant("it").startswith("OBJECT")))

    def text(name):
        return F.try_variant_get("it", f"$.{name}", "string")

    def kind(name):
        return F.schema_of_variant(F.try_variant_get("it", f"$.{name}", "variant"))

    given = F.try_variant_get("it", "$.confidence", "variant")
    conf = (F.when(given.isNull(), F.lit(0.0))
            .when(kind("confidence") == "BOOLEAN", F.when(text("confidence") == "true", 1.0).otherwise(0.0))
            .otherwise(text("confidence").try_cast("double")))
    out = ex.select(
        *keys, "item_pos",
        F.when(kind("actor") == "STRING", F.substring(text("actor"), 1, ACTOR_MAX)).alias("actor"),
        text("action").alias("action"),
        F.coalesce(text("reason"), F.lit("")).alias("reason"),
        F.coalesce(text("consequence"), F.lit("")).alias("consequence"),
        F.coalesce(text("full_statement"), F.lit("")).alias("full_statement"),
        conf.alias("confidence"))
    ok = (F.coalesce(F.length("actor"), F.lit(0)) > 0) & (F.coalesce(F.length("action"), F.lit(0)) > 0) \
        & F.col("confidence").isNotNull()
    return out.where(ok)


def with_article(statements: DataFrame, articles: DataFrame) -> DataFrame:
    """Statement ⋈ article (title, source, published_date)."""
    a = articles.select(F.col("id").alias("article_id"), F.col("title").alias("article_title"),
                        F.col("source").alias("article_source"), "published_date")
    return statements.join(a, "article_id")


def recent_confident(statements: DataFrame, articles: DataFrame, now, days: int,
                     min_conf: float = MIN_CONFIDENCE, vec_col: str | None = None) -> DataFrame:
    """Parent article within the look-back, statement vector present (when the
    statements carry one in ``vec_col``), confidence ≥ 0.5."""
    j = with_article(statements, articles)
    cond = (F.col("published_date") >= now - F.make_dt_interval(days=F.lit(days))) \
        & (F.col("confidence") >= min_conf)
    if vec_col:
        cond = cond & F.col(vec_col).isNotNull()
    return j.where(cond)


def unextracted(articles: DataFrame, statements: DataFrame) -> DataFrame:
    """Articles that have no statement yet."""
    return articles.join(statements.select(F.col("article_id").alias("id")).distinct(), "id", "left_anti")


# ---------------------------------------------------------------------------
# Model-answer adapter over ``conversations`` (FIXTURES.md §3).
# Fixed values of the test contract: one answer per conversation, shape by conv_id % 10.
# ---------------------------------------------------------------------------

def answers_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    variant = F.col("conv_id") % 10
    item = F.struct(
        F.col("role").alias("actor"),
        F.when((variant == 5) & (F.col("turn") % 2 == 1), F.lit(None).cast("string"))
        .otherwise(F.col("text")).alias("action"),
        F.lit("").alias("reason"), F.lit("").alias("consequence"),
        F.col("text").alias("full_statement"),
        F.when((variant != 8) | (F.col("turn") % 2 == 0), F.lit(0.1) * (F.col("turn") + 3)).alias("confidence"))
    per = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", item.alias("it")))).alias("_s"))
    lst = F.to_json(F.transform("_s", lambda x: x["it"]))
    first = F.to_json(F.col("_s")[0]["it"])
    v = F.col("conv_id") % 10
    with_nulls = F.to_json(F.transform("_s", lambda x: x["it"]), {"ignoreNullFields": "false"})
    resp = (F.when(v == 0, lst)
            .when(v == 1, F.concat(F.lit("```json\n"), lst, F.lit("\n```")))
            .when(v == 2, first)
            .when(v == 3, F.lit("Sorry, I cannot find statements in this article."))
            .when(v == 4, F.lit("[]"))
            .when(v == 6, F.concat(lst, F.lit(" These are all statements.")))
            .when(v == 7, F.translate(lst, '"', "'"))
            .when(v == 8, with_nulls)
            .when(v == 9, F.concat(F.lit('["none", '), F.substring(lst, 2, 2 ** 31 - 1)))
            .otherwise(lst))
    # Every answer belongs to an article, also when there are more conversations than documents.
    n_documents = read_table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    return per.select("conv_id", (F.col("conv_id") % n_documents).alias("article_id"), resp.alias("response"))


def statements_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement rows parsed from the answer adapter with a stable id."""
    s = parse_statements(answers_from_conversations(spark, sf_dir), ("conv_id", "article_id"))
    sid = F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("item_pos").cast("string")))
    return s.withColumn("id", sid).withColumn(
        "created_at", now_col() + F.make_dt_interval(secs=F.col("conv_id").cast("int")))
