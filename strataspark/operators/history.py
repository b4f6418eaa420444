"""Commit history: file and package metrics, ownership, co-change, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspark.functions.pair_codes import count_pairs, hashed, near, numbered
from strataspark.functions.text import package_path
from strataspark.plans.registry import register
from strataspark.plans.storage import cut
from strataspark.sources.tables import commit_files

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

#: The day from which recency counts. A parameter, so that results do not change with the clock.
AS_OF = "2026-01-01"
#: Weights of the risk factors, levels, and recency by age in days (fixed values).
WEIGHTS = {"churn": 0.25, "author_count": 0.20, "owner_concentration": 0.20, "cochange_breadth": 0.15, "recency": 0.20}
LEVELS = ((0.25, "low"), (0.5, "medium"), (0.75, "high"))
RECENCY = ((7, 1.0), (30, 0.7), (90, 0.4))
NEIGHBORS, CONTRIBUTORS = 10, 5
FILE = ["scope_key", "path"]

# --- operators ---------------------------------------------------------------


def file_metrics(changes: DataFrame) -> DataFrame:
    """Per file: commits, authors, days, lines and the last change. Unknown authors are one author."""
    return changes.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("commit_count"),
        F.countDistinct(F.coalesce("author", F.lit("unknown"))).alias("author_count"),
        F.countDistinct("commit_date").alias("active_days"),
        F.sum(F.coalesce("added", F.lit(0))).alias("added_lines"),
        F.sum(F.coalesce("deleted", F.lit(0))).alias("deleted_lines"),
        F.max("commit_date").alias("last_changed_at"),
    )


def contributors(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, email, commits, total, rank): authors of every group by commits, equal counts by address."""
    each = changes.groupBy(*keys, F.coalesce("author", F.lit("unknown")).alias("email")).agg(F.count(F.lit(1)).alias("commits"))
    w = Window.partitionBy(*keys)
    return each.withColumns(
        {"total": F.sum("commits").over(w), "rank": F.row_number().over(w.orderBy(F.desc("commits"), "email"))}
    )


def bus_factor(ranked: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """(keys, bus_factor): how many of the leading contributors hold `share` of the commits; all of those listed if they do not."""
    top = ranked.where(F.col("rank") <= CONTRIBUTORS)
    running = F.sum("commits").over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    reached = F.min(F.when(F.col("running") >= share * F.col("total"), F.col("rank")))
    return top.withColumn("running", running).groupBy(*keys).agg(F.coalesce(reached, F.max("rank")).alias("bus_factor"))


def cochange(changes: DataFrame, min_joint: int = 1) -> DataFrame:
    """(scope_key, target, neighbor, joint, strength, window_coverage): files that change in the same commit, in both directions.

    strength is the share of the commits of either that are commits of both,
    window_coverage that of the target's own. A commit of very many files is
    paired in blocks, over all tasks.
    """
    c = changes.select("scope_key", "sha", "path").dropna()
    counts = c.groupBy("scope_key", "path").agg(F.count(F.lit(1)).alias("n"))
    files = near(numbered(counts), "scope_key", "path")
    members = cut(c.join(files.select("scope_key", "path", "no"), ["scope_key", "path"]).select(*hashed("scope_key", "sha"), "no"))
    a = files.select(F.col("no").alias("no_a"), "scope_key", "path", F.col("n").alias("na"))
    b = files.select(F.col("no").alias("no_b"), F.col("path").alias("path2"), F.col("n").alias("nb"))
    both = count_pairs(members).withColumnRenamed("n_ab", "joint").where(F.col("joint") >= min_joint).join(a, "no_a").join(b, "no_b")
    way = lambda a, b, own: both.select(
        "scope_key", F.col(a).alias("target"), F.col(b).alias("neighbor"), "joint",
        (F.col("joint") / (F.col("na") + F.col("nb") - F.col("joint"))).alias("strength"),
        (F.col("joint") / F.col(own)).alias("window_coverage"),
    )
    return way("path", "path2", "na").unionByName(way("path2", "path", "nb"))


def nearest(edges: DataFrame, n: int = NEIGHBORS) -> DataFrame:
    """The n strongest neighbors of every target; equal strengths by name."""
    order = Window.partitionBy("scope_key", "target").orderBy(F.desc("strength"), "neighbor")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def recency(days: Column) -> Column:
    """The recency factor of an age in days."""
    out = F.lit(0.1)
    for limit, value in reversed(RECENCY):
        out = F.when(days <= limit, value).otherwise(out)
    return out


def risk_level(score: Column) -> Column:
    out = F.lit("critical")
    for limit, name in reversed(LEVELS):
        out = F.when(score < limit, name).otherwise(out)
    return out


def top_factor() -> Column:
    """The largest factor; of equal ones the first of WEIGHTS."""
    names = list(WEIGHTS)
    best = F.greatest(*names)
    out = F.lit(names[-1])
    for n in reversed(names[:-1]):
        out = F.when(F.col(n) == best, n).otherwise(out)
    return out


def file_risk(changes: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Risk factors, score, level and top factor of every file; counts are measured against the largest of the scope."""
    m = file_metrics(changes)
    owner = contributors(changes, FILE).where(F.col("rank") == 1).select(*FILE, (F.col("commits") / F.col("total")).alias("share"))
    breadth = nearest(cochange(changes)).groupBy("scope_key", F.col("target").alias("path")).agg(F.count(F.lit(1)).alias("neighbors"))
    most = m.groupBy("scope_key").agg(F.max("commit_count").alias("most_commits"), F.max("author_count").alias("most_authors"))
    log_share = lambda c, top: F.when(F.col(top) > 0, F.log1p(c) / F.log1p(top)).otherwise(0.0)
    days = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), "last_changed_at"))
    rows = m.join(owner, FILE).join(breadth, FILE, "left").join(most, "scope_key").select(
        *FILE,
        log_share("commit_count", "most_commits").alias("churn"),
        log_share("author_count", "most_authors").alias("author_count"),
        (1 - F.col("share")).alias("owner_concentration"),
        F.least(F.coalesce("neighbors", F.lit(0)) / NEIGHBORS, F.lit(1.0)).alias("cochange_breadth"),
        recency(days).alias("recency"),
    )
    score = sum((F.col(n) * v for n, v in WEIGHTS.items()), F.lit(0.0))
    return rows.withColumn("risk_score", F.round(score, 6)).withColumns(
        {"risk_level": risk_level(F.col("risk_score")), "top_factor": top_factor()}
    )


def package_metrics(changes: DataFrame, depth: int = 1) -> DataFrame:
    """Per package: distinct commits, exact sums, and of authors and days the largest of any of its files."""
    files = file_metrics(changes).withColumn("package", package_path(F.col("path"), depth))
    sums = files.groupBy("scope_key", "package").agg(
        F.count(F.lit(1)).alias("files"),
        F.max("author_count").alias("author_count"),
        F.max("active_days").alias("active_days"),
        F.sum("added_lines").alias("added_lines"),
        F.sum("deleted_lines").alias("deleted_lines"),
        F.max("last_changed_at").alias("last_changed_at"),
    )
    shas = changes.groupBy("scope_key", package_path(F.col("path"), depth).alias("package")).agg(F.countDistinct("sha").alias("commit_count"))
    return sums.join(shas, ["scope_key", "package"])


def package_contributors(changes: DataFrame, depth: int = 1) -> DataFrame:
    """(scope_key, package, email, commits, total, rank, primary_owner): authors of every package by its distinct commits; the owner is that of its file of most commits, of equal ones the first by path."""
    p = changes.withColumn("package", package_path(F.col("path"), depth))
    each = p.groupBy("scope_key", "package", "sha").agg(F.max("author").alias("author"))
    ranked = contributors(each, ["scope_key", "package"])
    files = file_metrics(changes).select(*FILE, "commit_count").withColumn("package", package_path(F.col("path"), depth))
    busiest = files.groupBy("scope_key", "package").agg(F.min_by("path", F.struct((-F.col("commit_count")).alias("n"), F.col("path"))).alias("path"))
    owner = contributors(changes, FILE).where(F.col("rank") == 1).select(*FILE, F.col("email").alias("primary_owner"))
    return ranked.join(busiest.join(owner, FILE).drop("path"), ["scope_key", "package"])


def exists_now(files: DataFrame, present: DataFrame) -> DataFrame:
    """Files with `currently_exists`: whether they are among the files present (scope_key, path)."""
    known = present.select(*FILE).distinct().withColumn("__e", F.lit(True))
    return files.join(known, FILE, "left").withColumn("currently_exists", F.coalesce("__e", F.lit(False))).drop("__e")


def package_cochange(changes: DataFrame, depth: int = 2, n: int = NEIGHBORS) -> DataFrame:
    """Packages that change together: joint changes of their files' nearest neighbors over the files' commits, 1 at most, n per package."""
    near = nearest(cochange(changes))
    p, q = package_path(F.col("target"), depth), package_path(F.col("neighbor"), depth)
    joint = (
        near.select("scope_key", p.alias("package"), q.alias("neighbor"), "joint")
        .where(F.col("package") != F.col("neighbor"))
        .groupBy("scope_key", "package", "neighbor")
        .agg(F.sum("joint").alias("joint"))
    )
    total = file_metrics(changes).groupBy("scope_key", package_path(F.col("path"), depth).alias("package")).agg(F.sum("commit_count").alias("commits"))
    edges = joint.join(total, ["scope_key", "package"]).withColumn("strength", F.least(F.lit(1.0), F.col("joint") / F.col("commits")))
    order = Window.partitionBy("scope_key", "package").orderBy(F.desc("strength"), "neighbor")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def parse_log(logs: DataFrame, text: str = "value") -> DataFrame:
    """(sha, author_email, commit_date, path, added, deleted) from raw log texts.

    A commit starts with a line COMMIT_START, then sha, author and date; lines
    of three tab-separated fields follow. Shas under 7 characters and odd dates
    drop the commit, a dash counts as 0, renames with braces are left out.
    """
    blocks = logs.select(F.explode(F.split(text, "COMMIT_START")).alias("block"))
    lines = F.filter(F.split("block", r"\r?\n"), lambda x: F.trim(x) != "")
    b = blocks.select(lines.alias("l")).where(F.size("l") >= 3)
    b = b.select(F.trim(F.col("l")[0]).alias("sha"), F.trim(F.col("l")[1]).alias("author_email"), F.trim(F.col("l")[2]).alias("day"), F.explode(F.expr("slice(l, 4, greatest(size(l) - 3, 0))")).alias("line"))
    b = b.where((F.length("sha") >= 7) & F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t.+$"))
    part = lambda i: F.regexp_extract("line", r"^(\d+|-)\t(\d+|-)\t(.+)$", i)
    number = lambda i: F.when(part(i) == "-", F.lit(0)).otherwise(F.expr("0") + part(i).try_cast("bigint"))
    return b.select(
        "sha", "author_email", F.col("day").try_cast("date").alias("commit_date"), part(3).alias("path"),
        number(1).cast("bigint").alias("added"), number(2).cast("bigint").alias("deleted"),
    ).where(~F.contains("path", F.lit("{")))


# --- queries -----------------------------------------------------------------

CF = """cf AS (SELECT scope_key, lower(sha) AS sha, path, max(lower(trim(author_email, ' ' || chr(9)))) AS author, max(commit_date) AS commit_date,
    max(added) AS added, max(deleted) AS deleted FROM commit_files WHERE path IS NOT NULL AND path <> '' AND NOT contains(path, ' => ') AND sha IS NOT NULL GROUP BY 1, 2, 3)"""
FM = """fm AS (SELECT scope_key, path, count(*) AS commit_count, count(DISTINCT coalesce(author, 'unknown')) AS author_count,
    count(DISTINCT commit_date) AS active_days, sum(coalesce(added, 0))::BIGINT AS added_lines, sum(coalesce(deleted, 0))::BIGINT AS deleted_lines,
    max(commit_date) AS last_changed_at FROM cf GROUP BY 1, 2)"""
CON = """con AS (SELECT *, sum(commits) OVER (PARTITION BY scope_key, path) AS total,
    row_number() OVER (PARTITION BY scope_key, path ORDER BY commits DESC, email) AS rank
    FROM (SELECT scope_key, path, coalesce(author, 'unknown') AS email, count(*) AS commits FROM cf GROUP BY 1, 2, 3))"""
CO = """jo AS (SELECT a.scope_key, a.path AS pa, b.path AS pb, count(*) AS joint FROM cf a JOIN cf b ON a.scope_key = b.scope_key AND a.sha = b.sha AND a.path < b.path GROUP BY 1, 2, 3),
  n AS (SELECT scope_key, path, count(*) AS n FROM cf GROUP BY 1, 2),
  jn AS (SELECT jo.*, x.n AS na, y.n AS nb FROM jo JOIN n x ON x.scope_key = jo.scope_key AND x.path = pa JOIN n y ON y.scope_key = jo.scope_key AND y.path = pb),
  co AS (SELECT scope_key, pa AS target, pb AS neighbor, joint, joint::DOUBLE / (na + nb - joint) AS strength, joint::DOUBLE / na AS window_coverage FROM jn
    UNION ALL SELECT scope_key, pb, pa, joint, joint::DOUBLE / (na + nb - joint), joint::DOUBLE / nb FROM jn),
  near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope_key, target ORDER BY strength DESC, neighbor) AS rank FROM co) WHERE rank <= 10)"""
PKG = "CASE WHEN NOT contains({0}, '/') THEN '.' ELSE array_to_string(string_split({0}, '/')[1:{1}], '/') END"
_SCORE = " + ".join(f"{n} * {v}::DOUBLE" for n, v in WEIGHTS.items())
RISK = f"""ri AS (SELECT *, round({_SCORE}, 6) AS risk_score, greatest({', '.join(WEIGHTS)}) AS best FROM (
    SELECT fm.scope_key, fm.path, ln(1 + commit_count) / ln(1 + max(commit_count) OVER w) AS churn, ln(1 + author_count) / ln(1 + max(author_count) OVER w) AS author_count,
      1 - commits / total::DOUBLE AS owner_concentration, least(coalesce(k, 0) / 10.0::DOUBLE, 1.0) AS cochange_breadth,
      CASE WHEN dd <= 7 THEN 1.0::DOUBLE WHEN dd <= 30 THEN 0.7 WHEN dd <= 90 THEN 0.4 ELSE 0.1 END AS recency
    FROM (SELECT *, greatest(0, date_diff('day', last_changed_at, DATE '{AS_OF}')) AS dd FROM fm) fm
    JOIN con ON con.scope_key = fm.scope_key AND con.path = fm.path AND con.rank = 1
    LEFT JOIN (SELECT scope_key, target, count(*) AS k FROM near GROUP BY 1, 2) b ON b.scope_key = fm.scope_key AND b.target = fm.path
    WINDOW w AS (PARTITION BY fm.scope_key)))"""
_LEVEL = "CASE WHEN risk_score < 0.25 THEN 'low' WHEN risk_score < 0.5 THEN 'medium' WHEN risk_score < 0.75 THEN 'high' ELSE 'critical' END"
_TOP = "CASE " + " ".join(f"WHEN {n} = best THEN '{n}'" for n in WEIGHTS) + " END"


def _c(spark: SparkSession, d: str) -> DataFrame:
    return commit_files(spark, d).where(F.col("scope_key").isNotNull())


CF = CF.replace("sha IS NOT NULL GROUP", "sha IS NOT NULL AND scope_key IS NOT NULL GROUP")


@query(f"WITH {CF}, {FM} SELECT * FROM fm")
def history_files(spark: SparkSession, d: str) -> DataFrame:
    return file_metrics(_c(spark, d))


@query(f"WITH {CF}, {CON} SELECT scope_key, path, email AS primary_owner, round(commits / total::DOUBLE, 6) AS primary_owner_share FROM con WHERE rank = 1")
def history_owners(spark: SparkSession, d: str) -> DataFrame:
    c = contributors(_c(spark, d), FILE).where(F.col("rank") == 1)
    return c.select(*FILE, F.col("email").alias("primary_owner"), F.round(F.col("commits") / F.col("total"), 6).alias("primary_owner_share"))


@query(f"WITH {CF}, {CON} SELECT scope_key, path, email, commits, rank, round(commits / total::DOUBLE, 6) AS share FROM con WHERE rank <= 5")
def history_contributors(spark: SparkSession, d: str) -> DataFrame:
    c = contributors(_c(spark, d), FILE).where(F.col("rank") <= CONTRIBUTORS)
    return c.select(*FILE, "email", "commits", "rank", F.round(F.col("commits") / F.col("total"), 6).alias("share"))


@query(f"""WITH {CF}, {CON}, t AS (SELECT *, sum(commits) OVER (PARTITION BY scope_key, path ORDER BY rank) AS running FROM con WHERE rank <= 5)
    SELECT scope_key, path, coalesce(min(CASE WHEN running >= 0.5 * total THEN rank END), max(rank)) AS bus_factor FROM t GROUP BY 1, 2""")
def history_bus_factor(spark: SparkSession, d: str) -> DataFrame:
    return bus_factor(contributors(_c(spark, d), FILE), FILE)


@query(f"WITH {CF}, {CO} SELECT scope_key, target, neighbor, joint, round(strength, 6) AS strength, round(window_coverage, 6) AS window_coverage, rank FROM near")
def history_cochange(spark: SparkSession, d: str) -> DataFrame:
    n = nearest(cochange(_c(spark, d)))
    return n.withColumns({c: F.round(c, 6) for c in ("strength", "window_coverage")})


@query(f"""WITH {CF}, {FM}, {CON}, {CO}, {RISK} SELECT scope_key, path, round(churn, 6) AS churn, round(author_count, 6) AS author_count,
    round(owner_concentration, 6) AS owner_concentration, cochange_breadth, recency, risk_score, {_LEVEL} AS risk_level FROM ri""")
def history_risk(spark: SparkSession, d: str) -> DataFrame:
    r = file_risk(_c(spark, d)).drop("top_factor")
    return r.withColumns({c: F.round(c, 6) for c in ("churn", "author_count", "owner_concentration")})


@query(f"WITH {CF}, {FM}, {CON}, {CO}, {RISK} SELECT scope_key, path, risk_score, {_TOP} AS top_factor FROM ri ORDER BY risk_score DESC, scope_key, path LIMIT 3")
def history_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """The 3 files of most risk."""
    return file_risk(_c(spark, d)).select(*FILE, "risk_score", "top_factor").orderBy(F.desc("risk_score"), *FILE).limit(3)


@query(f"""WITH {CF}, {FM}, {CON}, {CO}, {RISK}, want AS (SELECT DISTINCT scope_key, path FROM commit_files WHERE contains(path, ' => ') OR path = 'docs/CHANGELOG.md')
    SELECT want.scope_key, want.path, risk_score, ri.path IS NOT NULL AS found FROM want LEFT JOIN ri ON ri.scope_key = want.scope_key AND ri.path = want.path WHERE want.scope_key IS NOT NULL""")
def history_evidence(spark: SparkSession, d: str) -> DataFrame:
    """An evidence pack: risk of wanted files, and which of them have no history."""
    from strataspark.sources.tables import table

    want = table(spark, d, "commit_files").where(F.contains("path", F.lit(" => ")) | (F.col("path") == "docs/CHANGELOG.md"))
    want = want.where(F.col("scope_key").isNotNull()).select(*FILE).distinct()
    r = file_risk(_c(spark, d)).select(*FILE, "risk_score")
    return want.join(r, FILE, "left").withColumn("found", F.col("risk_score").isNotNull())


_P1, _P2 = PKG.format("path", 1), PKG.format("path", 2)


@query(f"""WITH {CF}, {FM} SELECT a.*, commit_count FROM (SELECT scope_key, {_P2} AS package, count(*) AS files, max(author_count) AS author_count, max(active_days) AS active_days,
      sum(added_lines)::BIGINT AS added_lines, sum(deleted_lines)::BIGINT AS deleted_lines, max(last_changed_at) AS last_changed_at FROM fm GROUP BY 1, 2) a
    JOIN (SELECT scope_key, {_P2} AS package, count(DISTINCT sha) AS commit_count FROM cf GROUP BY 1, 2) b USING (scope_key, package)""")
def history_packages(spark: SparkSession, d: str) -> DataFrame:
    return package_metrics(_c(spark, d), 2)


@query(f"""WITH {CF} SELECT scope_key, {_P2} AS package, count(DISTINCT sha) AS commits, count(DISTINCT coalesce(author, 'unknown')) AS authors, count(DISTINCT commit_date) AS days FROM cf GROUP BY 1, 2""")
def history_packages_exact(spark: SparkSession, d: str) -> DataFrame:
    """Distinct commits, authors and days of every package, exactly."""
    return _c(spark, d).groupBy("scope_key", package_path(F.col("path"), 2).alias("package")).agg(
        F.countDistinct("sha").alias("commits"),
        F.countDistinct(F.coalesce("author", F.lit("unknown"))).alias("authors"),
        F.countDistinct("commit_date").alias("days"),
    )


_PT, _PN = PKG.format("target", 2), PKG.format("neighbor", 2)


@query(f"""WITH {CF}, {FM}, {CO}, j AS (SELECT scope_key, {_PT} AS package, {_PN} AS nb, sum(joint)::BIGINT AS joint FROM near WHERE {_PT} <> {_PN} GROUP BY 1, 2, 3),
      t AS (SELECT scope_key, {_P2} AS package, sum(commit_count)::BIGINT AS commits FROM fm GROUP BY 1, 2),
      s AS (SELECT scope_key, package, nb AS neighbor, joint, commits, least(1.0::DOUBLE, joint::DOUBLE / commits) AS strength FROM j JOIN t USING (scope_key, package))
    SELECT scope_key, package, neighbor, joint, commits, round(strength, 6) AS strength, rank FROM
      (SELECT *, row_number() OVER (PARTITION BY scope_key, package ORDER BY strength DESC, neighbor) AS rank FROM s) WHERE rank <= 10""")
def history_package_cochange(spark: SparkSession, d: str) -> DataFrame:
    return package_cochange(_c(spark, d)).withColumn("strength", F.round("strength", 6))


@query(f"WITH {CF}, {FM} SELECT scope_key, path, added_lines + deleted_lines AS churn, commit_count FROM fm ORDER BY churn DESC, scope_key, path LIMIT 5")
def history_top_churn(spark: SparkSession, d: str) -> DataFrame:
    """The 5 files with most changed lines."""
    m = file_metrics(_c(spark, d)).select(*FILE, (F.col("added_lines") + F.col("deleted_lines")).alias("churn"), "commit_count")
    return m.orderBy(F.desc("churn"), *FILE).limit(5)


@query(f"""WITH {CF}, {FM}, {CO} SELECT target AS path, scope_key, round(count(*) FILTER (WHERE starts_with(neighbor, 'docs/') OR neighbor LIKE '%.md')::DOUBLE / count(*), 6) AS doc_gap FROM near GROUP BY 1, 2""")
def history_doc_gap(spark: SparkSession, d: str) -> DataFrame:
    """Share of documents among the nearest neighbors of every file."""
    n = nearest(cochange(_c(spark, d)))
    doc = F.startswith("neighbor", F.lit("docs/")) | F.endswith("neighbor", F.lit(".md"))
    return n.groupBy("scope_key", F.col("target").alias("path")).agg(F.round(F.avg(doc.cast("double")), 6).alias("doc_gap"))


@query(f"""WITH {CF}, {FM}, {CON}, e AS (SELECT scope_key, {_P2} AS package, sha, coalesce(max(author), 'unknown') AS email FROM cf GROUP BY 1, 2, 3),
      r AS (SELECT *, sum(commits) OVER (PARTITION BY scope_key, package) AS total, row_number() OVER (PARTITION BY scope_key, package ORDER BY commits DESC, email) AS rank
        FROM (SELECT scope_key, package, email, count(*) AS commits FROM e GROUP BY 1, 2, 3)),
      b AS (SELECT scope_key, {_P2} AS package, path, row_number() OVER (PARTITION BY scope_key, {_P2} ORDER BY commit_count DESC, path) AS k FROM fm)
    SELECT r.scope_key, r.package, r.email, r.commits, r.total::BIGINT AS total, r.rank, con.email AS primary_owner FROM r JOIN b ON b.scope_key = r.scope_key AND b.package = r.package AND k = 1
      JOIN con ON con.scope_key = b.scope_key AND con.path = b.path AND con.rank = 1 WHERE r.rank <= 5""")
def history_package_contributors(spark: SparkSession, d: str) -> DataFrame:
    """The first 5 contributors and the owner of every package."""
    return package_contributors(_c(spark, d), 2).where(F.col("rank") <= CONTRIBUTORS)


@query(f"""WITH {CF} SELECT scope_key, {_P2} AS package, count(DISTINCT sha) AS commit_count FROM cf GROUP BY 1, 2 ORDER BY commit_count DESC, scope_key, package LIMIT 5""")
def history_top_packages(spark: SparkSession, d: str) -> DataFrame:
    """The 5 packages of most commits."""
    return package_metrics(_c(spark, d), 2).select("scope_key", "package", "commit_count").orderBy(F.desc("commit_count"), "scope_key", "package").limit(5)


@query(f"""WITH {CF}, {FM}, e AS (SELECT DISTINCT scope_key, source_location.file AS path FROM entities WHERE removed_at IS NULL AND source_location.file IS NOT NULL),
      x AS (SELECT fm.scope_key, fm.path, commit_count, e.path IS NOT NULL AS currently_exists FROM fm LEFT JOIN e ON e.scope_key = fm.scope_key AND e.path = fm.path)
    SELECT * FROM (SELECT * FROM x WHERE currently_exists ORDER BY commit_count DESC, scope_key, path LIMIT 5) UNION ALL SELECT * FROM (SELECT * FROM x WHERE NOT currently_exists ORDER BY commit_count DESC, scope_key, path LIMIT 3)""")
def history_present_and_deleted(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most changed files in which entities lie, and the 3 most changed of the others."""
    from strataspark.sources.tables import table

    present = table(spark, d, "entities").where(F.col("removed_at").isNull()).select("scope_key", F.col("source_location.file").alias("path")).dropna()
    f = exists_now(file_metrics(_c(spark, d)).select(*FILE, "commit_count"), present)
    first = lambda there, n: f.where(F.col("currently_exists") == there).orderBy(F.desc("commit_count"), *FILE).limit(n)
    return first(True, 5).unionByName(first(False, 3))
