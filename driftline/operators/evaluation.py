"""Evaluation of a clustering: profiles, shares, noise rates and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.codes import vessel_class
from driftline.schema import DEFAULT_TYPE, VESSEL_CLASSES

#: Features whose importance over several clusterings is compared.
COMPARED = ("speed_avg", "speed_std", "speed_max", "duration", "displacement", "length_over_displacement", "cog_std", "lat_mean", "lon_mean")
PROFILE = ("speed_avg", "speed_std", "speed_max", "duration", "lat_mean", "lon_mean", "cog_std")
FLOOR = 1e-6
TINY = 1e-9


def with_types(labelled: DataFrame, types: DataFrame) -> DataFrame:
    """``labelled`` with the vessel's type, or the default, and its class."""
    joined = labelled.join(types, "mmsi", "left").withColumn("vessel_type", F.coalesce("vessel_type", F.lit(DEFAULT_TYPE)))
    return joined.withColumn("vessel_class", vessel_class("vessel_type"))


def standard_scores(rows: DataFrame, names: tuple[str, ...] = PROFILE) -> DataFrame:
    """Each value less the mean over its sample deviation, over all rows, noise included."""
    facts = rows.agg(*[f(n).alias(f"{n}_{s}") for n in names for s, f in (("m", F.avg), ("d", F.stddev_samp))])
    wide = rows.crossJoin(F.broadcast(facts))  # one row
    return wide.withColumns({n: F.try_divide(F.col(n) - F.col(f"{n}_m"), F.col(f"{n}_d")) for n in names}).drop(*facts.columns)


def profile(rows: DataFrame, names: tuple[str, ...] = PROFILE) -> DataFrame:
    """Mean scores of each cluster; noise is left out after scaling."""
    return standard_scores(rows, names).filter("label <> -1").groupBy("label").agg(*[F.avg(n).alias(n) for n in names])


def importance(rows: DataFrame, names: tuple[str, ...] = PROFILE) -> DataFrame:
    """(feature, importance): how far the clusters' mean scores are spread, the widest first."""
    wide = profile(rows, names).agg(*[F.stddev_samp(n).alias(n) for n in names])
    stacked = ", ".join(f"'{n}', {n}" for n in names)
    return wide.selectExpr(f"stack({len(names)}, {stacked}) as (feature, importance)").orderBy(F.desc_nulls_last("importance"), "feature")


def greatest_importance(rows: DataFrame, clusterings: tuple[str, ...], names: tuple[str, ...] = PROFILE) -> DataFrame:
    """(rank, feature, importance): each feature's largest importance over several label columns, the largest first.

    The scores are those of all rows, whatever their labels; one pass serves all clusterings.
    """
    scored = standard_scores(rows, names)
    labels = F.array(*[F.struct(F.lit(i).alias("clustering"), F.col(c).cast("int").alias("label")) for i, c in enumerate(clusterings)])
    each = scored.select(*names, F.explode(labels).alias("_by")).filter("_by.label <> -1")
    means = each.groupBy("_by").agg(*[F.avg(n).alias(n) for n in names])
    wide = means.groupBy("_by.clustering").agg(*[F.stddev_samp(n).alias(n) for n in names])
    stacked = ", ".join(f"'{n}', {n}" for n in names)
    best = wide.selectExpr(f"stack({len(names)}, {stacked}) as (feature, importance)").groupBy("feature").agg(F.max("importance").alias("importance"))
    # a row for each feature
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("importance"), "feature"))
    return best.select(rank.alias("rank"), "feature", "importance").orderBy("rank")


def shares(rows: DataFrame) -> DataFrame:
    """(label, vessel_class, share, overall) over rows that aren't noise, for every class of the fixed list."""
    kept = rows.filter("label <> -1")
    one = [F.avg((F.col("vessel_class") == c).cast("int")).alias(f"c{i}") for i, c in enumerate(VESSEL_CLASSES)]
    by, overall = kept.groupBy("label").agg(*one), kept.agg(*[o.alias(f"g{i}") for i, o in enumerate(one)])
    stacked = ", ".join(f"'{c}', c{i}, g{i}" for i, c in enumerate(VESSEL_CLASSES))
    return by.crossJoin(F.broadcast(overall)).selectExpr("label", f"stack({len(VESSEL_CLASSES)}, {stacked}) as (vessel_class, share, overall)")


def share_difference(rows: DataFrame) -> DataFrame:
    return shares(rows).select("label", "vessel_class", (F.col("share") - F.col("overall")).alias("difference"))


def pointwise_information(rows: DataFrame) -> DataFrame:
    """log2 of a cluster's share over the overall one, missing shares taken as 1e-6."""
    least = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(FLOOR))
    return shares(rows).select("label", "vessel_class", F.log2(least("share") / least("overall")).alias("pmi"))


def noise_percent(rows: DataFrame) -> DataFrame:
    return rows.agg((100 * F.avg((F.col("label") == -1).cast("int"))).alias("noise_pct"))


def noise_scores(rows: DataFrame, names: tuple[str, ...] = PROFILE) -> DataFrame:
    """(feature, z): the mean of noise less that of clusters over the clusters' sample deviation."""
    noise, kept = F.col("label") == -1, F.col("label") != -1
    z = [F.try_divide(F.avg(F.when(noise, F.col(n))) - F.avg(F.when(kept, F.col(n))), F.stddev_samp(F.when(kept, F.col(n)))).alias(n) for n in names]
    stacked = ", ".join(f"'{n}', {n}" for n in names)
    return rows.agg(*z).selectExpr(f"stack({len(names)}, {stacked}) as (feature, z)")


def noise_information(rows: DataFrame) -> DataFrame:
    """(vessel_class, pmi): log2 of the share among noise over that among clusters, missing ones taken as 1e-6."""
    noise, kept = F.col("label") == -1, F.col("label") != -1
    share = lambda c, who: F.avg(F.when(who, (F.col("vessel_class") == c).cast("int")))
    wide = rows.agg(*[share(c, who).alias(f"{p}{i}") for i, c in enumerate(VESSEL_CLASSES) for p, who in (("n", noise), ("k", kept))])
    stacked = ", ".join(f"'{c}', n{i}, k{i}" for i, c in enumerate(VESSEL_CLASSES))
    least = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(FLOOR))
    return wide.selectExpr(f"stack({len(VESSEL_CLASSES)}, {stacked}) as (vessel_class, n, k)").select("vessel_class", F.log2(least("n") / least("k")).alias("pmi"))


def noise_grid(distances: DataFrame, thresholds: list[float]) -> DataFrame:
    """(n_clusters, threshold, noise_pct) from (key, n_clusters, dist): one pass, all thresholds at once."""
    counts = [(100 * F.avg((F.col("dist") > t).cast("int"))).alias(f"t{i}") for i, t in enumerate(thresholds)]
    stacked = ", ".join(f"{t!r}D, t{i}" for i, t in enumerate(thresholds))
    return distances.groupBy("n_clusters").agg(*counts).selectExpr("n_clusters", f"stack({len(thresholds)}, {stacked}) as (threshold, noise_pct)")


def group_loss(scored: DataFrame, by: str) -> DataFrame:
    """The mean loss of each group weighted by batch size; 0 for an empty one."""
    return scored.groupBy(by).agg(F.coalesce(F.try_divide(F.sum(F.col("loss") * F.col("n")), F.sum("n")), F.lit(0.0)).alias("loss"))


def reconstruction_ratio(scored: DataFrame) -> DataFrame:
    """One row: the noise's loss over the clusters' loss."""
    mean = lambda who: F.coalesce(F.try_divide(F.sum(F.when(who, F.col("loss") * F.col("n"))), F.sum(F.when(who, F.col("n")))), F.lit(0.0))
    return scored.agg((mean(F.col("label") == -1) / (mean(F.col("label") != -1) + TINY)).alias("rcr"))


def masked_mse(predicted: DataFrame) -> DataFrame:
    """Mean squared error over (key, prediction, labels) rows whose labels are all set; null where there is none."""
    ok = predicted.filter(F.forall("labels", lambda x: x != -100.0))
    long = ok.select(F.explode(F.arrays_zip("prediction", "labels")).alias("z"))
    return long.agg(F.avg((F.col("z.prediction") - F.col("z.labels")) * (F.col("z.prediction") - F.col("z.labels"))).alias("mse"))


def exemplars(vectors: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` members of each cluster nearest to its centroid."""
    from .clustering import with_centroid_distance

    w = Window.partitionBy("label").orderBy("dist", "vec_id")
    return with_centroid_distance(vectors).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("label", "rank", "vec_id", "dist")
