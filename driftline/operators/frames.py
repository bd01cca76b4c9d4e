"""The frames behind the figures; drawing them is left to other tools."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .voyages import denormalise


def reduced(vectors: DataFrame, vector: str = "embedding", dimensions: int = 2) -> DataFrame:
    """``vectors`` with ``point``: the first principal components of the centred vectors.

    A component's sign is chosen so that its largest loading is positive.  The covariances are
    summed on the workers; a matrix of the vectors' width reaches the driver.
    """
    rows = vectors.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = PCA(k=dimensions, inputCol="_v", outputCol="_p").fit(rows)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] > 0 else -1.0 for i in range(dimensions)]
    # the model projects without centring
    mean = rows.select(F.posexplode(vector_to_array("_v")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    shift = (np.array([r["m"] for r in mean]) @ loadings).tolist() if mean else [0.0] * dimensions
    point = vector_to_array("_p")
    return model.transform(rows).withColumn("point", F.array(*[(point[i] - shift[i]) * signs[i] for i in range(dimensions)])).drop("_v", "_p")


def scatter(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, label, x, y): the points of a scatter plot."""
    return reduced(vectors, vector).select(key, "label", F.col("point")[0].alias("x"), F.col("point")[1].alias("y"))


def trajectories(steps: DataFrame, label: str = "label") -> DataFrame:
    """(mmsi, k, place, lat, lon, label, is_start, is_end, aspect) of normalised steps, in degrees.

    ``aspect`` is one over the cosine of the mean latitude of all, which makes a map's degrees even.
    """
    rows = denormalise(steps.select("mmsi", "k", "step", "lat", "lon", "sog", "cog", label))
    order = Window.partitionBy("mmsi", "k").orderBy("step")
    mean = rows.agg(F.avg("lat").alias("_mean"))  # one row
    placed = rows.withColumns({"place": (F.row_number().over(order) - 1).cast("int"), "is_end": F.lead(F.lit(1)).over(order).isNull()}).crossJoin(F.broadcast(mean))
    return placed.select("mmsi", "k", "place", "lat", "lon", label, (F.col("place") == 0).alias("is_start"), "is_end", (1 / F.cos(F.radians("_mean"))).alias("aspect"))


def lollipop(profile: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(label, rank, feature, score, positive) of a profile's mean scores, each cluster's from the least to the greatest."""
    long = profile.selectExpr("label", f"stack({len(names)}, {', '.join(f"'{n}', {n}" for n in names)}) as (feature, score)")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("score", "feature"))
    return long.select("label", rank.alias("rank"), "feature", "score", (F.col("score") >= 0).alias("positive"))
