"""Structure as numbers: weighted adjacency, projection, intrinsic dimension, clusters and drift.

The adjacency matrix is never dense: it is (src, dst, weight) rows, and what
the dense form would add as zeros enters statistics as counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspark.plans.registry import register
from strataspark.plans.storage import cut
from strataspark.sources.graph import EDGE, edges
from strataspark.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

#: Weight of a relation by type; any other weighs 1 (fixed values).
RELATION_WEIGHTS = {"inheritance": 2.0, "implementation": 2.0, "composition": 1.5}
#: Drift from which a level begins (fixed values).
DRIFT_LEVELS = ((3.0, "critical"), (1.5, "significant"), (0.5, "moderate"))

# --- operators ---------------------------------------------------------------


def relation_weight(kind: Column) -> Column:
    out = F.lit(1.0)
    for name, w in RELATION_WEIGHTS.items():
        out = F.when(kind == name, w).otherwise(out)
    return out


def adjacency(es: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(src, dst, w): edges between the same two vertices add up."""
    return es.groupBy(*(keys or []), "src", "dst").agg(F.sum(relation_weight(F.col("rel_type"))).alias("w"))


def column_statistics(a: DataFrame, vertices: int) -> DataFrame:
    """(dst, mean, sd): of every column of the n x n matrix, its zeros included; population deviation."""
    mean = F.sum("w") / vertices
    var = F.greatest(F.lit(0.0), F.sum(F.col("w") * F.col("w")) / vertices - mean * mean)
    return a.groupBy("dst").agg(mean.alias("mean"), F.sqrt(var).alias("sd"))


#: Directions of random signs that are made at once for the columns of a batch (some 30 MB).
SIGNS = 1 << 22
#: Parts over which a row with many entries is summed up.
ROW_PARTS = 64


def target_dimension(n: int, epsilon: float = 0.3) -> int:
    """Dimensions that keep distances of n points within a factor of 1 +- epsilon."""
    return math.ceil(4 * math.log(n) / epsilon**2) if n > 1 else 1


def _signs(columns: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The k entries of every column, given by its hash: +1, -1 and 0 (1/6, 1/6, 4/6), from a mixing of hash, direction and seed."""
    x = columns.view(np.uint64)[:, None] + (np.arange(k, dtype=np.uint64) + np.uint64(seed * 0x1F123BB5))[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    r = (x ^ x >> np.uint64(31)) % np.uint64(6)
    return (r == 0).astype(np.float64) - (r == 1)


def project(a: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(src, x ARRAY<DOUBLE>): rows of the sparse matrix (src, dst, w) on k random directions of entries +-1 and 0, scaled to keep lengths.

    A direction's entry is the hash of the column, the dimension and the seed:
    no random matrix is stored or sent. Entries are shuffled once, by row, and
    a row's k sums are made where its entries lie, one column's signs at a
    time; rows with many entries are summed up in parts.
    """
    from strataspark.operators.skew import heavy_keys, is_heavy

    scale = math.sqrt(3.0 / k)
    many = heavy_keys(a.select("src"), "src", 0.005, 0.05)
    part = F.when(is_heavy(F.col("src"), many), F.pmod(F.xxhash64("dst"), F.lit(ROW_PARTS))).otherwise(F.lit(0))
    kind = dict(a.dtypes)["src"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = None, None  # the row that the next batch may go on with
        for b in batches:
            if not len(b):
                continue
            names, at = [], []
            step = max(1, SIGNS // k)
            done: list[np.ndarray] = []
            for lo in range(0, len(b), step):
                some = b.iloc[lo : lo + step]
                sums = _signs(some["h"].to_numpy(np.int64), k, seed) * some["w"].to_numpy(float)[:, None]
                src = some["src"].to_numpy()
                at = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
                for name, x in zip(src[at], np.add.reduceat(sums, at)):
                    if held is not None and name == held:
                        total += x
                        continue
                    if held is not None:
                        names.append(held)
                        done.append(total * scale)
                    held, total = name, x
            if names:
                yield pd.DataFrame({"src": names, "x": done})
        if held is not None:
            yield pd.DataFrame({"src": [held], "x": [total * scale]})

    rows = a.where(F.col("src").isNotNull()).select("src", F.xxhash64("dst").alias("h"), F.col("w").cast("double").alias("w"), part.alias("__p"))
    made = rows.repartition("src", "__p").sortWithinPartitions("src", "__p").select("src", "h", "w").mapInPandas(fold, f"src {kind}, x array<double>")
    if not many:
        return made
    mine = is_heavy(F.col("src"), many)
    cells = made.where(mine).select("src", F.posexplode("x").alias("i", "v")).groupBy("src", "i").agg(F.sum("v").alias("v"))
    whole = cells.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("x"))
    return made.where(~mine).unionByName(whole)


def _moments(column: str):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, gram = 0, None, None
        for b in batches:
            x = np.array([v for v in b[column] if v is not None], float)
            if not len(x):
                continue
            n += len(x)
            total = x.sum(0) if total is None else total + x.sum(0)
            gram = x.T @ x if gram is None else gram + x.T @ x
        if n:
            d = len(total)
            i, j = np.divmod(np.arange(d * d), d)
            yield pd.DataFrame({"i": [-2, *[-1] * d, *i], "j": [0, *range(d), *j], "v": [float(n), *total, *gram.ravel()]})

    return fold


def intrinsic_dimension(rows: DataFrame, column: str, share: float = 0.95) -> tuple[int, list[float]]:
    """The number of directions that hold `share` of the variance of the vectors, and their cumulative shares.

    One pass adds up the moments of the partitions; only the d x d matrix of
    the vectors' dimensions reaches the driver. Null vectors are left out; no
    vectors or no variance give 0.
    """
    parts = rows.select(column).mapInPandas(_moments(column), "i int, j int, v double")
    cells = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if not len(cells):
        return 0, []
    n = cells.v[cells.i == -2].iloc[0]
    mean = cells[cells.i == -1].sort_values("j").v.to_numpy() / n
    gram = cells[cells.i >= 0].sort_values(["i", "j"]).v.to_numpy().reshape(len(mean), -1)
    values = np.clip(np.linalg.eigvalsh(gram / n - np.outer(mean, mean))[::-1], 0, None)
    if values.sum() <= 1e-12:
        return 0, []
    curve = np.cumsum(values) / values.sum()
    at = int(np.searchsorted(curve, share - 1e-12)) + 1
    return at, curve[: at + 10].tolist()


def clusters(rows: DataFrame, column: str, k: int, seed: int = 1) -> DataFrame:
    """The rows with `cluster`, by k-means; the vectors are arrays of numbers."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = rows.where(F.col(column).isNotNull()).withColumn("__v", array_to_vector(F.col(column).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster", maxIter=20).fit(v)
    return model.transform(v).drop("__v")


def boundary(assigned: DataFrame, package: str = "package", cluster: str = "cluster", least: int = 3) -> DataFrame:
    """(package, size, dominant, purity, coverage, score): how far packages and clusters agree, for packages of a least size.

    purity is the share of the package in its dominant cluster, coverage that
    of the cluster in the package; of equal counts the smaller cluster counts.
    """
    cells = assigned.groupBy(package, cluster).agg(F.count(F.lit(1)).alias("n"))
    p, c = Window.partitionBy(package), Window.partitionBy(cluster)
    cells = cells.withColumns(
        {"size": F.sum("n").over(p), "cluster_size": F.sum("n").over(c), "r": F.row_number().over(p.orderBy(F.desc("n"), cluster))}
    )
    top = cells.where((F.col("r") == 1) & (F.col("size") >= least))
    purity, coverage = F.col("n") / F.col("size"), F.col("n") / F.col("cluster_size")
    return top.select(
        package, "size", F.col(cluster).alias("dominant"), F.round(purity, 4).alias("purity"), F.round(coverage, 4).alias("coverage"),
        F.round((purity + coverage) / 2, 4).alias("score"),
    )


def _shares(assigned: DataFrame, whole: str, part: str) -> DataFrame:
    """(whole, part, n, size, ratio, r): the parts of every whole with their shares, the largest first, of equal ones the smaller part."""
    cells = assigned.groupBy(whole, part).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(whole)
    return cells.withColumns({"size": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), part))}).withColumn("ratio", F.col("n") / F.col("size"))


def split_packages(assigned: DataFrame, package: str = "package", cluster: str = "cluster", least: int = 3, purity: float = 0.5) -> DataFrame:
    """(package, purity, clusters, ratios): packages of at least `least` entities with less than `purity` in their dominant cluster.

    The clusters are listed with their shares, the largest first. Purity is compared rounded to four digits.
    """
    c = _shares(assigned, package, cluster).where(F.col("size") >= least)
    g = c.groupBy(package).agg(F.round(F.max("ratio"), 4).alias("purity"), F.sort_array(F.collect_list(F.struct("r", F.col(cluster).alias("cluster"), F.round("ratio", 6).alias("ratio")))).alias("d"))
    return g.where(F.col("purity") < purity).select(package, "purity", F.col("d.cluster").alias("clusters"), F.col("d.ratio").alias("ratios"))


def drift_level(drift: Column) -> Column:
    out = F.lit("stable")
    for limit, name in reversed(DRIFT_LEVELS):
        out = F.when(drift >= limit, name).otherwise(out)
    return out


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, status, drift, level, delta_out): the distance of every vertex' row between two adjacencies.

    A vertex may be in one of them only (added, removed). Rows that are equal
    drift by 0.
    """
    b, a = before.withColumnRenamed("w", "w1"), after.withColumnRenamed("w", "w2")
    cells = b.join(a, ["src", "dst"], "full")
    w1, w2 = F.coalesce("w1", F.lit(0.0)), F.coalesce("w2", F.lit(0.0))
    rows = cells.groupBy("src").agg(
        F.sqrt(F.sum(F.pow(w2 - w1, 2))).alias("drift"), F.sum(w2 - w1).alias("delta_out"), F.count("w1").alias("c1"), F.count("w2").alias("c2")
    )
    status = F.when(F.col("c1") == 0, "added").when(F.col("c2") == 0, "removed").otherwise("shared")
    return rows.select("src", status.alias("status"), F.round("drift", 6).alias("drift"), drift_level(F.round("drift", 6)).alias("level"), "delta_out")


# --- queries -----------------------------------------------------------------

_W = "CASE rel_type WHEN 'inheritance' THEN 2.0::DOUBLE WHEN 'implementation' THEN 2.0 WHEN 'composition' THEN 1.5 ELSE 1.0 END"
_SPLIT = "2025-07-01"


@query(f"WITH {EDGE} SELECT src, dst, sum({_W}) AS w FROM edge GROUP BY 1, 2")
def weighted_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return adjacency(edges(spark, d, "rel_type"))


@query(f"""WITH {EDGE}, a AS (SELECT src, dst, sum({_W}) AS w FROM edge GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM ent)
    SELECT dst, round(sum(w) / max(n), 9) AS mean, round(sqrt(greatest(0.0, sum(w * w) / max(n) - (sum(w) / max(n)) * (sum(w) / max(n)))), 9) AS sd FROM a, n GROUP BY 1""")
def adjacency_columns(spark: SparkSession, d: str) -> DataFrame:
    from strataspark.sources.tables import current_entities

    s = column_statistics(adjacency(edges(spark, d, "rel_type")), current_entities(spark, d, "id").count())
    return s.withColumns({c: F.round(c, 9) for c in ("mean", "sd")})


@query(f"""WITH {EDGE}, k AS (SELECT id FROM (SELECT id, arg_max(observed_at, ingested_at) AS o FROM relations WHERE id IS NOT NULL GROUP BY 1) WHERE o < TIMESTAMP '{_SPLIT}'),
      b AS (SELECT src, dst, sum({_W}) AS w FROM edge WHERE id IN (SELECT id FROM k) GROUP BY 1, 2), a AS (SELECT src, dst, sum({_W}) AS w FROM edge GROUP BY 1, 2),
      c AS (SELECT coalesce(b.src, a.src) AS src, b.w AS w1, a.w AS w2 FROM b FULL JOIN a ON a.src = b.src AND a.dst = b.dst),
      r AS (SELECT src, round(sqrt(sum(power(coalesce(w2, 0) - coalesce(w1, 0), 2))), 6) AS drift, sum(coalesce(w2, 0) - coalesce(w1, 0)) AS delta_out, count(w1) AS c1, count(w2) AS c2 FROM c GROUP BY 1)
    SELECT src, CASE WHEN c1 = 0 THEN 'added' WHEN c2 = 0 THEN 'removed' ELSE 'shared' END AS status, drift, delta_out,
      CASE WHEN drift >= 3 THEN 'critical' WHEN drift >= 1.5 THEN 'significant' WHEN drift >= 0.5 THEN 'moderate' ELSE 'stable' END AS level FROM r""")
def adjacency_drift(spark: SparkSession, d: str) -> DataFrame:
    """Drift of every entity between its relations up to a day and all of them."""
    e = edges(spark, d, "rel_type")
    seen = table(spark, d, "relations").where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by("observed_at", "ingested_at").alias("o"))
    old = e.join(seen.where(F.col("o") < F.lit(_SPLIT).cast("timestamp")).select("id"), "id", "left_semi")
    return drift(adjacency(old), adjacency(e))


@query(f"WITH {EDGE} SELECT key FROM ent WHERE key NOT IN (SELECT src FROM edge)")
def adjacency_empty_rows(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose row of the adjacency is empty."""
    from strataspark.sources.tables import current_entities

    return current_entities(spark, d, "id").select("key").join(edges(spark, d, "rel_type").select(F.col("src").alias("key")), "key", "left_anti")


@query()
def projected_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the adjacency on as many random directions as their number of entities asks for, and how far the projection keeps their squared lengths."""
    from strataspark.sources.tables import current_entities

    k = target_dimension(current_entities(spark, d, "id").count())
    a = cut(adjacency(edges(spark, d, "rel_type")))  # read by the search for long rows, the projection and the lengths
    p = project(a, k).select("src", F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x).alias("projected"))
    true = a.groupBy("src").agg(F.sum(F.col("w") * F.col("w")).alias("length"))
    return true.join(p, "src").select("src", "length", "projected")


@query()
def embedding_dimension(spark: SparkSession, d: str) -> DataFrame:
    """The intrinsic dimension of the embeddings with the curve of explained variance."""
    n, curve = intrinsic_dimension(table(spark, d, "embeddings"), "embedding")
    rows = [(n, i + 1, float(c)) for i, c in enumerate(curve)]
    return spark.createDataFrame(rows, "dimension int, directions int, explained double")


@query()
def cluster_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the modules of all scopes, by their names, with clusters of the entities' projected rows."""
    from strataspark.sources.tables import current_entities

    packages = current_entities(spark, d, "id").select("key", F.split("key", r"\.")[1].alias("package")).where(F.col("package").isNotNull())
    return boundary_report(cut(adjacency(edges(spark, d, "rel_type"))), packages, search=False)["scores"]


@query()
def embedding_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the embeddings' labels with clusters."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").alias("package"))
    return boundary(clusters(e, "embedding", 10))


@query("""WITH c AS (SELECT label AS package, vec_id % 7 AS cluster, count(*) AS n FROM embeddings GROUP BY 1, 2),
      x AS (SELECT *, sum(n) OVER (PARTITION BY package) AS size, sum(n) OVER (PARTITION BY cluster) AS cs, row_number() OVER (PARTITION BY package ORDER BY n DESC, cluster) AS r FROM c)
    SELECT package, size::BIGINT AS size, cluster AS dominant, round(n / size, 4)::DOUBLE AS purity, round(n / cs, 4)::DOUBLE AS coverage, round((n / size + n / cs) / 2, 4)::DOUBLE AS score FROM x WHERE r = 1 AND size >= 3""")
def boundary_scores(spark: SparkSession, d: str) -> DataFrame:
    """Boundary scores of labels against a fixed partition of the embeddings."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("package"), F.pmod("vec_id", F.lit(7)).alias("cluster"))
    return boundary(e)


_CELLS = """c AS (SELECT label AS package, CASE WHEN vec_id % 7 < 3 THEN 0 ELSE vec_id % 7 END AS cluster, count(*) AS n FROM embeddings GROUP BY 1, 2)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    seven = F.pmod("vec_id", F.lit(7))
    return table(spark, d, "embeddings").select(F.col("label").alias("package"), F.when(seven < 3, 0).otherwise(seven).alias("cluster"))


@query(f"""WITH {_CELLS}, x AS (SELECT *, sum(n) OVER (PARTITION BY package) AS size, row_number() OVER (PARTITION BY package ORDER BY n DESC, cluster) AS r FROM c)
    SELECT package, round(max(n / size), 4)::DOUBLE AS purity, list(cluster ORDER BY r) AS clusters, list(round(n / size, 6)::DOUBLE ORDER BY r) AS ratios
    FROM x WHERE size >= 3 GROUP BY 1 HAVING round(max(n / size), 4) < 0.5::DOUBLE""")
def split_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that a fixed partition of the embeddings splits, and how."""
    return split_packages(_cells(spark, d))


@query(f"""WITH {_CELLS}, x AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS size FROM c)
    SELECT cluster, count(*) AS packages, round(max(n / size), 6)::DOUBLE AS dominant_ratio FROM x GROUP BY 1 HAVING 1 - max(n / size) > 0.6::DOUBLE AND max(n / size) < 0.5::DOUBLE""")
def fused_labels(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a fixed partition of the embeddings that mix labels."""
    return fusions(_cells(spark, d))


@query(f"""WITH {_CELLS}, x AS (SELECT *, sum(n) OVER (PARTITION BY package) AS size, sum(n) OVER (PARTITION BY cluster) AS cs, row_number() OVER (PARTITION BY package ORDER BY n DESC, cluster) AS r FROM c)
    SELECT round(coalesce(sum(size * round((n / size + n / cs) / 2, 4)) / sum(size), 0), 4)::DOUBLE AS score FROM x WHERE r = 1 AND size >= 3""")
def boundary_score_of_all(spark: SparkSession, d: str) -> DataFrame:
    """The boundary score of the whole partition."""
    return global_score(boundary(_cells(spark, d)))


# --- choosing clusters, what clusters say, and gates ---------------------------


#: Points up to which a silhouette is exact, and as many are drawn of more (fixed value).
SILHOUETTE = 2000


def silhouette(assigned: DataFrame, column: str, cluster: str = "cluster", sample: int = SILHOUETTE, seed: int = 42) -> float:
    """The mean silhouette by Euclidean distance: of all points if there are at most `sample`, else of as many drawn ones, each against all points.

    The drawn points are bounded and go to all workers; every batch adds up
    its distances to them per cluster. A point alone in its cluster counts 0.
    """
    rows = assigned.where(F.col(column).isNotNull() & F.col(cluster).isNotNull()).select(F.col(cluster).cast("int").alias("c"), F.col(column).cast("array<double>").alias("x"))
    drawn = rows.orderBy(F.xxhash64("x", "c", F.lit(seed))).limit(sample).collect()
    if not drawn:
        return 0.0
    own = np.array([r.c for r in drawn])
    shared = assigned.sparkSession.sparkContext.broadcast(np.array([r.x for r in drawn]))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, sums, counts = shared.value, {}, {}
        square = (points * points).sum(1)[:, None]
        for b in batches:
            for c, part in b.groupby("c")["x"]:
                for lo in range(0, len(part), 1000):
                    x = np.stack(part.iloc[lo : lo + 1000].to_numpy()).astype(float)
                    d = np.sqrt(np.clip(square + (x * x).sum(1)[None, :] - 2 * points @ x.T, 0, None))
                    sums[c] = sums.get(c, 0) + d.sum(1)
                    counts[c] = counts.get(c, 0) + len(x)
        for c, total in sums.items():
            yield pd.DataFrame({"c": c, "i": np.arange(len(total)), "d": total, "n": counts[c]})

    cells = rows.mapInPandas(fold, "c int, i int, d double, n bigint").groupBy("c", "i").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).toPandas()
    cells["own"] = own[cells["i"]] == cells["c"]
    mine = cells[cells.own].set_index("i")
    inside = (mine.d / (mine.n - 1)).where(mine.n > 1)
    outside = (cells[~cells.own].assign(m=lambda t: t.d / t.n)).groupby("i").m.min()
    both = pd.DataFrame({"a": inside, "b": outside}).reindex(range(len(drawn)))
    score = ((both.b - both.a) / both[["a", "b"]].max(axis=1)).where(both.notna().all(axis=1), 0.0)
    return float(score.fillna(0.0).mean())


#: Silhouette under which there is no clear structure (fixed value).
UNCLEAR = 0.2
#: Vertices from which rows are projected (fixed value).
DIRECT = 1000


def choose_clusters(rows: DataFrame, column: str, around: int, seed: int = 1) -> tuple[int, float, DataFrame]:
    """The number of clusters from max(2, around - 2) to around + 3 of the best silhouette, that silhouette, and the rows with `cluster`."""
    best = None
    for k in range(max(2, around - 2), around + 4):
        c = clusters(rows, column, k, seed)
        if c.select("cluster").distinct().count() < 2:
            continue
        s = silhouette(c, column)
        if best is None or s > best[1]:
            best = (k, s, c)
    if best is None:
        raise ValueError("the vectors make no two clusters")
    return best


def features(a: DataFrame, vertices: int, threshold: int = DIRECT) -> tuple[str, DataFrame]:
    """(mode, (src, x)): the rows of an adjacency (src, dst, w) as vectors: direct ones below the threshold of vertices, else projected ones. Vertices without edges out have no row."""
    if vertices >= threshold:
        return "jl", project(a, target_dimension(vertices))
    columns = [r[0] for r in a.select("dst").distinct().orderBy("dst").collect()]  # fewer than the threshold
    cells = a.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "w"))).alias("m"))
    return "direct", cells.select("src", F.array(*[F.coalesce(F.element_at("m", F.lit(c)), F.lit(0.0)) for c in columns]).alias("x"))


def boundary_report(a: DataFrame, packages: DataFrame, around: int | None = None, search: bool = True, seed: int = 42) -> dict:
    """How far the packages of a graph agree with its clusters.

    `a` is the adjacency, `packages` (key, package) names all vertices. Those
    without edges out are orphans and left out; the others are clustered, in
    as many clusters as there are packages or, by `search`, near that many.
    mode, clusters, silhouette, score and a warning where there is no clear
    structure are numbers and texts; scores, splits, fusions, summaries and
    orphans are DataFrames.
    """
    present = packages.join(a.select(F.col("src").alias("key")).distinct(), "key", "left_semi")
    n = present.count()
    if n < 2:
        raise ValueError("fewer than two vertices with edges out")
    mode, rows = features(a, n)
    around = around or present.select("package").distinct().count()
    around = max(2, min(around, n))
    if search:
        k, s, c = choose_clusters(rows, "x", around, seed)
    else:
        k, c = around, clusters(rows, "x", around, seed)
        s = silhouette(c, "x")
    assigned = c.select(F.col("src").alias("key"), "cluster").join(present, "key").select("key", "package", "cluster")
    scores = boundary(assigned)
    return {
        "mode": mode, "clusters": k, "silhouette": round(s, 4), "warning": "no clear cluster structure" if s < UNCLEAR else None, "score": global_score(scores).collect()[0][0],
        "scores": scores, "splits": split_packages(assigned), "fusions": fusions(assigned), "summaries": cluster_summaries(assigned),
        "orphans": packages.join(present.select("key"), "key", "left_anti"),
    }


def normalized(a: DataFrame, vertices: int) -> DataFrame:
    """(src, dst, z, zero_z): the entries of the matrix as z-scores of their columns, and that of the column's zeros; 0 where nothing varies."""
    s = column_statistics(a, vertices)
    z = lambda w: F.when(F.col("sd") > 0, (w - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return a.join(s, "dst").select("src", "dst", z(F.col("w")).alias("z"), z(F.lit(0.0)).alias("zero_z"))


def fusions(assigned: DataFrame, package: str = "package", cluster: str = "cluster", cross: float = 0.6, dominant: float = 0.5) -> DataFrame:
    """(cluster, packages, dominant_ratio): clusters of which more than `cross` lies outside of the dominant package, which holds less than `dominant`."""
    g = _shares(assigned, cluster, package).groupBy(cluster).agg(F.count(F.lit(1)).alias("packages"), F.max("ratio").alias("dominant_ratio"))
    return g.where((1 - F.col("dominant_ratio") > cross) & (F.col("dominant_ratio") < dominant)).withColumn("dominant_ratio", F.round("dominant_ratio", 6))


def global_score(scores: DataFrame) -> DataFrame:
    """(score): the mean boundary score of all packages, weighted by their sizes; 0 if there are none."""
    return scores.agg(F.round(F.coalesce(F.sum(F.col("size") * F.col("score")) / F.sum("size"), F.lit(0.0)), 4).alias("score"))


def cluster_summaries(assigned: DataFrame, package: str = "package", cluster: str = "cluster") -> DataFrame:
    """(cluster, size, packages, dominant): of equal packages the first by name is dominant."""
    cells = assigned.groupBy(cluster, package).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(cluster).orderBy(F.desc("n"), package)
    top = cells.withColumn("r", F.row_number().over(order))
    return top.groupBy(cluster).agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("packages"), F.max(F.when(F.col("r") == 1, F.col(package))).alias("dominant"))


def align(before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    """(key, status): shared, added or removed between two lists of entities; repeated ones count once."""
    a, b = before.select(key, F.lit(1).alias("a")).distinct(), after.select(key, F.lit(1).alias("b")).distinct()
    status = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise("shared")
    return a.join(b, key, "full").select(key, status.alias("status"))


def drift_exit_code(valid: bool, baseline: bool, levels: list[str], gate: str = "critical") -> int:
    """2 for a commit that does not exist, 0 without a baseline, 1 where any level reaches the gate, else 0."""
    order = ["stable", "moderate", "significant", "critical"]
    if not valid:
        return 2
    return int(baseline and any(order.index(x) >= order.index(gate) for x in levels))


@query(f"""WITH e AS (SELECT DISTINCT lower(trim(id, ' ' || chr(9))) AS key, first_seen_at AS f, removed_at AS r FROM entities WHERE id IS NOT NULL),
      a AS (SELECT DISTINCT key FROM e WHERE f <= TIMESTAMP '2025-01-01' AND (r IS NULL OR r > TIMESTAMP '2025-01-01')), b AS (SELECT DISTINCT key FROM e WHERE f <= TIMESTAMP '{_SPLIT}' AND (r IS NULL OR r > TIMESTAMP '{_SPLIT}'))
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'removed' WHEN a.key IS NULL THEN 'added' ELSE 'shared' END AS status FROM a FULL JOIN b ON a.key = b.key""")
def entity_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Entities shared by two days, added and removed between them."""
    from strataspark.functions.text import plain

    e = table(spark, d, "entities").where(F.col("id").isNotNull()).select(plain("id").alias("key"), "first_seen_at", "removed_at")

    def on(day: str) -> DataFrame:
        t = F.lit(day).cast("timestamp_ntz")
        return e.where((F.col("first_seen_at") <= t) & (F.col("removed_at").isNull() | (F.col("removed_at") > t)))

    return align(on("2025-01-01"), on(_SPLIT))


@query("""WITH c AS (SELECT vec_id % 7 AS cluster, label AS package, count(*) AS n FROM embeddings GROUP BY 1, 2),
      x AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, package) AS r FROM c)
    SELECT cluster, sum(n)::BIGINT AS size, count(*) AS packages, max(CASE WHEN r = 1 THEN package END) AS dominant FROM x GROUP BY 1""")
def partition_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What the parts of a fixed partition of the embeddings hold."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("package"), F.pmod("vec_id", F.lit(7)).alias("cluster"))
    return cluster_summaries(e)
