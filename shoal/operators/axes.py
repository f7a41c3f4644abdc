"""Axis scores, TF-IDF, projections and principal components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.operators.profiles import top_k


def min_max(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Scale columns to 0-1 over all rows, 0.5 where they don't vary; the raw values are kept."""
    ends = rows.agg(*(f(c).alias(f"{c}_{n}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi"))))
    out = rows.join(F.broadcast(ends))  # one row
    for c in cols:
        lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        out = out.withColumn(f"{c}_raw", F.col(c)).withColumn(c, F.when(hi == lo, 0.5).otherwise((F.col(c) - lo) / (hi - lo))).drop(f"{c}_lo", f"{c}_hi")
    return out


def tfidf(terms: DataFrame, min_df: int, max_features: int) -> DataFrame:
    """(doc, term, value): 1 + ln tf, smoothed idf + 1, rows of unit length.

    ``terms`` has a row a token. The features are those of the highest count, ties by term.
    """
    tf = terms.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df).orderBy(F.col("total").desc(), "term").limit(max_features)
    n = terms.agg(F.countDistinct("doc").alias("n"))
    raw = tf.join(F.broadcast(stats), "term").join(F.broadcast(n))  # max_features rows, and one
    raw = raw.withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("w") / norm).alias("value"))


def long_features(rows: DataFrame, key: str, vector: Column, group: str) -> DataFrame:
    """(key, group, dim, value) of an array column."""
    return rows.select(key, group, F.posexplode(vector).alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


def centred(features: DataFrame) -> DataFrame:
    means = features.groupBy("dim").agg(F.avg("value").alias("mean"))
    return features.join(F.broadcast(means), "dim").withColumn("value", F.col("value") - F.col("mean")).drop("mean")


def projection(features: DataFrame, group: str) -> DataFrame:
    """Mean and population deviation of each dimension in each group of two or more."""
    return features.groupBy(group, "dim").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n")).where("n >= 2")


def eta_squared(features: DataFrame, group: str) -> DataFrame:
    """Share of each dimension's variance that lies between groups."""
    g = features.groupBy("dim", group).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    t = g.groupBy("dim").agg(F.sum("n").alias("nn"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mm"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = g.join(t, "dim").groupBy("dim").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mm"), 2)).alias("between"), F.first("within").alias("within"))
    total = F.col("between") + F.col("within")
    return between.select("dim", F.when(total == 0, 0.0).otherwise(F.col("between") / total).alias("eta2"))


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation with average ranks of ties, in each group; null where a side does not vary."""
    out = rows
    for c in (x, y):
        at = F.row_number().over(Window.partitionBy(*by).orderBy(c))
        out = out.withColumn("at_", at).withColumn(f"r_{c}", F.avg("at_").over(Window.partitionBy(*by, c))).drop("at_")
    spread = F.stddev_pop(f"r_{x}") * F.stddev_pop(f"r_{y}")
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.covar_pop(f"r_{x}", f"r_{y}") / F.nullif(spread, F.lit(0.0))))
    return out.groupBy(*by).agg(F.when(spread > 0, r).alias("r"), F.count(F.lit(1)).alias("n"))


def student_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation over n pairs, by Student's t with n - 2 degrees of freedom.

    The finite series of the distribution for whole degrees of freedom; null under three pairs.
    """
    df = n - 2
    theta = F.atan2(F.abs(r), F.sqrt(1 - r * r))  # tan = t / sqrt(df)
    cos2, odd = 1 - r * r, df % 2 == 1
    # terms 1, a1 c, a2 c^2, ...: a_k = (2k - 1) / 2k for even df, 2k / (2k + 1) for odd df
    steps = F.when(df >= 4, F.sequence(F.lit(1), F.floor((df - 2) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc, k):
        term = acc["term"] * cos2 * F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(steps, start, step)["sum"]
    inner = F.when(df == 1, 2 * theta / np.pi).when(odd, 2 / np.pi * (theta + F.abs(r) * F.sqrt(cos2) * series)).otherwise(F.abs(r) * series)
    return F.when(df < 1, None).otherwise(F.greatest(F.lit(0.0), 1 - inner))


def axis_correlations(projections: DataFrame, scores: DataFrame, least: int = 4) -> DataFrame:
    """Rank correlation, and its p, of each component (cluster, pc, mean) with each axis (cluster, axis, score) over shared clusters."""
    both = projections.join(scores, "cluster")
    out = spearman(both, "mean", "score", ["pc", "axis"]).where(F.col("n") >= least)
    return out.select("pc", "axis", F.round("r", 3).alias("r"), F.round(student_p(F.col("r"), F.col("n")), 3).alias("p"), "n")


def dense_terms(values: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc, vector) over the terms of a TF-IDF table, and the terms in order; as many as its max_features."""
    terms = [r.term for r in values.select("term").distinct().orderBy("term").collect()]
    at = values.sparkSession.createDataFrame(list(enumerate(terms)), "i int, term string")
    rows = values.join(F.broadcast(at), "term").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("m"))
    return rows.select("doc", F.transform(F.sequence(F.lit(0), F.lit(len(terms) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector")), terms


def loadings(spark, parts: np.ndarray, terms: list[str]) -> DataFrame:
    """(pc, term, loading) of components over terms."""
    return spark.createDataFrame([(i + 1, t, float(x)) for i, part in enumerate(parts) for t, x in zip(terms, part)], "pc long, term string, loading double")


def top_loadings(table: DataFrame, k: int = 12) -> DataFrame:
    """The k terms of greatest and of least loading on each component."""
    up = top_k(table, ["pc"], [F.col("loading").desc(), F.col("term")], k).withColumn("side", F.lit("positive"))
    return up.unionByName(top_k(table, ["pc"], [F.col("loading"), F.col("term")], k).withColumn("side", F.lit("negative")))


def term_projection(values: DataFrame, table: DataFrame) -> DataFrame:
    """(doc, pc, value): coordinates of documents of a TF-IDF table on components, centred."""
    dots = values.join(F.broadcast(table), "term").groupBy("doc", "pc").agg(F.sum(F.col("value") * F.col("loading")).alias("value"))  # components x max_features rows
    means = dots.groupBy("pc").agg(F.avg("value").alias("mean"))
    return dots.join(F.broadcast(means), "pc").select("doc", "pc", (F.col("value") - F.col("mean")).alias("value"))


def pca(rows: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(components, explained variance shares): the covariance is summed on the cluster.

    Only the width of the vectors squared reaches the driver. A component's largest
    loading is positive.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.feature import PCA, StandardScaler

    v = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    scaled = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(v).transform(v)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(scaled)
    parts = model.pc.toArray().T
    sign = np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])
    return parts * sign[:, None], model.explainedVariance.toArray()


_MOMENTS = "cluster long, label string, n long, s array<double>, q array<double>"


def _moments(rows: DataFrame, salts: int = 32, held: int = 64) -> DataFrame:
    """(cluster, label, n, s, q): count, sums and sums of products of vectors, a row a cluster and label.

    Summed within tasks first, then in salted groups, so no task takes all rows or all
    partial sums of a cluster. ``held`` bounds the sums that a task keeps.
    """

    def frame(sums: dict) -> pd.DataFrame:
        return pd.DataFrame([(c, g, n, x.tolist(), q.ravel().tolist()) for (c, g), (n, x, q) in sums.items()], columns=["cluster", "label", "n", "s", "q"])

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            for (c, g), part in pdf.groupby(["cluster", "label"], dropna=False):
                x = np.array(part["v"].tolist(), dtype=float)
                n, t, q = sums.get(key := (c, None if pd.isna(g) else g), (0, 0.0, 0.0))
                sums[key] = (n + len(x), t + x.sum(axis=0), q + x.T @ x)
                if len(sums) > held:
                    yield frame(sums)
                    sums = {}
        if sums:
            yield frame(sums)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        label = pdf["label"].iloc[0]
        return frame({(pdf["cluster"].iloc[0], label): (int(pdf["n"].sum()), np.sum(pdf["s"].tolist(), axis=0), np.sum(pdf["q"].tolist(), axis=0))})

    parts = rows.mapInPandas(partial, _MOMENTS).withColumn("salt", F.spark_partition_id() % salts)
    salted = parts.groupBy("cluster", "label", "salt").applyInPandas(merge, _MOMENTS)
    return salted.groupBy("cluster", "label").applyInPandas(merge, _MOMENTS)


def local_pca(rows: DataFrame, group: str, vector: str, label: str, most: int = 6, least: int = 8, labelled: int = 6, features: int = 3) -> DataFrame:
    """(cluster, pc, explained, eta2): principal components within each group, and eta squared of the labels on each.

    All of it follows from the moments of each label, so members stay where they are. A
    group needs ``least`` members, ``features`` dimensions, two labels and ``labelled``
    members with one; rows without label count for the components alone.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known, n, d = pdf[pdf["label"].notna()], int(pdf["n"].sum()), len(pdf["s"].iloc[0])
        if n < least or d < features or len(known) < 2 or known["n"].sum() < labelled:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("cluster", "int64"), ("pc", "int64"), ("explained", "float64"), ("eta2", "float64"))})

        def scatter(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            mean = np.sum(part["s"].tolist(), axis=0) / part["n"].sum()
            return mean, np.sum(part["q"].tolist(), axis=0).reshape(d, d) - part["n"].sum() * np.outer(mean, mean)

        values, axes_ = np.linalg.eigh(scatter(pdf)[1])
        k = min(most, d, n - 1)
        values, parts, (mean, within) = values[::-1], axes_[:, ::-1].T[:k], scatter(known)
        total = np.einsum("ij,jk,ik->i", parts, within, parts)
        sizes, means = known["n"].to_numpy(), np.array(known["s"].tolist()) / known["n"].to_numpy()[:, None]
        between = (sizes[:, None] * ((means - mean) @ parts.T) ** 2).sum(axis=0)
        share = np.maximum(values, 0) / max(np.maximum(values, 0).sum(), 1e-12)
        eta = np.where(total > 1e-12, between / np.maximum(total, 1e-12), 0.0).round(3)
        return pd.DataFrame({"cluster": int(pdf["cluster"].iloc[0]), "pc": np.arange(1, k + 1), "explained": share[:k], "eta2": eta})

    flat = rows.select(F.col(group).cast("long").alias("cluster"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label")).where("cluster is not null and v is not null")
    return _moments(flat).groupBy("cluster").applyInPandas(run, "cluster long, pc long, explained double, eta2 double")
