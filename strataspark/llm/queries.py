"""The queries of the operators of this folder, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.text import plain
from strataspark.llm import leaks, pairs, quantiles, residue, tokenize, topn
from strataspark.plans.parallel import spread
from strataspark.sources.tables import table

QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
GROUP = ["model", "format_name"]


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.valid_scores(table(spark, d, "task_results"), plain)


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of every model and format over all run dates, out of those of single dates."""
    daily = quantiles.partial_sketches(_scores(spark, d), [*GROUP, "run_date"], "mean_score")
    return quantiles.merge_sketches(daily.drop("run_date"), GROUP)


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of every model and format over all run dates, out of the sketches of single dates."""
    return quantiles.estimates(_whole(spark, d), QUANTILES, GROUP)


def p1_monthly(spark: SparkSession, d: str) -> DataFrame:
    """The same per month, joined from the sketches of its dates."""
    daily = quantiles.partial_sketches(_scores(spark, d), [*GROUP, "run_date"], "mean_score")
    monthly = quantiles.merge_sketches(daily.withColumn("month", F.trunc("run_date", "month")).drop("run_date"), [*GROUP, "month"])
    return quantiles.estimates(monthly, QUANTILES, [*GROUP, "month"])


def p1_rank_error(spark: SparkSession, d: str) -> DataFrame:
    """(model, format_name, percentile, within): whether the exact rank of every estimate is off by less than the stated limit."""
    told = p1_percentiles(spark, d)
    names = [quantiles.column(q) for q in QUANTILES]
    rows = _scores(spark, d).select(*GROUP, "mean_score").join(told.drop("n"), GROUP)
    below = [F.count_if(F.col("mean_score") < F.col(c)).alias(f"{c}_lt") for c in names]
    upto = [F.count_if(F.col("mean_score") <= F.col(c)).alias(f"{c}_le") for c in names]
    ranks = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), *below, *upto)

    def within(q: float, c: str) -> Column:
        rank = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n")))
        off = F.greatest(F.col(f"{c}_lt") + 1 - rank, rank - F.col(f"{c}_le"), F.lit(0))
        return off - 1 <= quantiles.LIMIT * F.least(rank, F.col("n") - rank + 1)

    each = F.array(*[F.struct(F.lit(c).alias("percentile"), within(q, c).alias("within")) for q, c in zip(QUANTILES, names)])
    return ranks.select(*GROUP, F.explode(each).alias("x")).select(*GROUP, "x.percentile", "x.within")


def p1_daily(spark: SparkSession, d: str) -> DataFrame:
    """The sketches of single run dates, to be kept and joined into any longer period."""
    return quantiles.sketches(_scores(spark, d), [*GROUP, "run_date"], "mean_score")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Results that count, per model and format, with the exact extremes: what the sketches must agree with."""
    return _scores(spark, d).groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.min("mean_score").alias("least"), F.max("mean_score").alias("most")
    )


def _contributors(spark: SparkSession, d: str, n: int) -> DataFrame:
    o = table(spark, d, "ownership_contributors").withColumn("email", plain("email"))
    return topn.top_n(o, "target", "email", "commit_count", n, "generated_at")


def _neighbors(spark: SparkSession, d: str, n: int) -> DataFrame:
    return topn.top_n(table(spark, d, "cochange_neighbors"), "target", "neighbor", "joint_change_count", n, "generated_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The first 5 contributors and the first 10 neighbors of every target."""
    a = _contributors(spark, d, 5).select(F.lit("contributor").alias("kind"), "target", F.col("email").alias("item"))
    b = _neighbors(spark, d, 10).select(F.lit("neighbor").alias("kind"), "target", F.col("neighbor").alias("item"))
    return a.unionByName(b)


def p5_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The first 10 neighbors of every target with their counts and ranks."""
    return _neighbors(spark, d, 10)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commit_files").withColumn("sha", F.lower("sha"))
    c = c.where((F.col("path") != "") & ~F.contains(F.col("path"), F.lit(" => ")))
    return pairs.frequent_pairs(c, "scope_key", "sha", "path")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of paths that change together at least 5 times and 4 times as often as by chance."""
    return _pairs(spark, d).select("scope_key", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


def p6_scored(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their counts, lift and corrected log odds ratio."""
    p = _pairs(spark, d)
    return p.select(
        "scope_key", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"), "n_ab", "n_a", "n_b", "n_all",
        F.round("lift", 6).alias("lift"), F.round("log_odds", 6).alias("log_odds"),
    )


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return tokenize.encode(_documents(spark, d), "doc_id", "text")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, encoded and decoded again."""
    return tokenize.decode(p7_ids(spark, d), "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share a run of words with the passage of an evaluation item."""
    return leaks.leaks(_documents(spark, d), table(spark, d, "eval_items"))


def p8_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    """Documents that follow the template of an item's passage, with its own or other fillings of the slots."""
    return leaks.reparameterised(_documents(spark, d), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are template residue, filler, error pages or notices."""
    return residue.residue(_documents(spark, d)).select("doc_id")


def p9_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Number of residue documents by reason and source."""
    found = residue.residue(_documents(spark, d))
    return found.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_percentiles, p1_monthly, p1_daily, p1_counts, p1_rank_error, p5_found, p5_ranked, p6_found, p6_scored, p7_ids, p7_decoded,
        p8_found, p8_reparameterised, p9_found, p9_reasons,
    )
}

_TRIM = "lower(trim({}, ' ' || chr(9)))"
_LATEST = """
    SELECT target, item, n, row_number() OVER (PARTITION BY target ORDER BY n DESC, item) AS rank FROM (
      SELECT target, {item} AS item, {n} AS n, row_number() OVER (PARTITION BY target, {item} ORDER BY generated_at DESC NULLS LAST, {n} DESC) AS v
      FROM {table} WHERE {n} IS NOT NULL) WHERE v = 1"""
_OWN = _LATEST.format(item=_TRIM.format("email"), n="commit_count", table="ownership_contributors")
_NEAR = _LATEST.format(item="neighbor", n="joint_change_count", table="cochange_neighbors")
_TOGETHER = """
    WITH c AS (SELECT DISTINCT scope_key, lower(sha) AS sha, path FROM commit_files
               WHERE path <> '' AND path NOT LIKE '% => %' AND scope_key IS NOT NULL AND sha IS NOT NULL),
         a AS (SELECT scope_key, count(DISTINCT sha) AS n_all FROM c GROUP BY 1),
         i AS (SELECT scope_key, path, count(*) AS n FROM c GROUP BY 1, 2),
         p AS (SELECT x.scope_key, x.path AS path_a, y.path AS path_b, count(*) AS n_ab
               FROM c x JOIN c y ON x.scope_key = y.scope_key AND x.sha = y.sha AND x.path < y.path
               GROUP BY 1, 2, 3 HAVING count(*) >= 5),
         r AS (SELECT p.*, i.n AS n_a, j.n AS n_b, n_all FROM p
               JOIN i ON i.scope_key = p.scope_key AND i.path = path_a JOIN i j ON j.scope_key = p.scope_key AND j.path = path_b
               JOIN a ON a.scope_key = p.scope_key WHERE n_ab * n_all >= 4 * i.n * j.n)
"""

_VALID = f"""
        WITH r AS (SELECT result_id, {_TRIM.format('model')} AS model, {_TRIM.format('format_name')} AS format_name, mean_score,
                     row_number() OVER (PARTITION BY result_id ORDER BY ingested_at NULLS FIRST, run_date NULLS FIRST,
                       {_TRIM.format('model')}, {_TRIM.format('format_name')}, mean_score) AS rn
                   FROM task_results WHERE {_TRIM.format('model')} <> '' AND {_TRIM.format('format_name')} <> ''
                     AND mean_score IS NOT NULL AND NOT isnan(mean_score) AND mean_score BETWEEN 0 AND 1)"""

SQL = {
    "p1_counts": _VALID + "SELECT model, format_name, count(*) AS n, min(mean_score) AS least, max(mean_score) AS most FROM r WHERE rn = 1 OR result_id IS NULL GROUP BY 1, 2",
    "p1_rank_error": _VALID + f"""SELECT DISTINCT model, format_name, percentile, true AS within
        FROM r, (SELECT unnest({[quantiles.column(q) for q in QUANTILES]}) AS percentile) WHERE rn = 1 OR result_id IS NULL""",
    "p5_found": f"SELECT 'contributor' AS kind, target, item FROM ({_OWN}) WHERE rank <= 5 UNION ALL SELECT 'neighbor', target, item FROM ({_NEAR}) WHERE rank <= 10",
    "p5_ranked": f"SELECT target, item AS neighbor, n AS joint_change_count, rank FROM ({_NEAR}) WHERE rank <= 10",
    "p6_found": _TOGETHER + "SELECT scope_key, path_a, path_b FROM r",
    "p6_scored": _TOGETHER + """SELECT *, round(n_ab * n_all / (n_a * n_b)::DOUBLE, 6) AS lift,
        round(ln((n_ab + 0.5::DOUBLE) * (n_all - n_a - n_b + n_ab + 0.5::DOUBLE) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE))), 6) AS log_odds FROM r""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
