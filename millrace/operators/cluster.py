"""K-means assignment and principal components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.cast import number
from millrace.functions.names import numeric_columns, quoted


def _assembled(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    full = df.select(*[F.col(quoted(k)) for k in keep], *[number(df, n).alias(f"_x{i}") for i, n in enumerate(columns)])
    full = full.na.drop(subset=[f"_x{i}" for i in range(len(columns))])
    return VectorAssembler(inputCols=[f"_x{i}" for i in range(len(columns))], outputCol="raw").transform(full)


def assign_kmeans(df: DataFrame, columns: Sequence[str], k: int = 3, silhouette: bool = True, seed: int = 42):
    """The table with ``cluster_id`` (NULL for incomplete rows) and a summary of the fit."""
    if k < 2:
        raise ValueError(f"k must be 2 or more, got {k}")
    data = _assembled(df, columns)
    rows = data.count()
    if rows < k:
        raise ValueError(f"need at least {k} complete rows, have {rows}")
    model = KMeans(k=k, seed=seed, featuresCol="raw", predictionCol="cluster_id").fit(data)
    point = F.array(*[number(df, n) for n in columns])
    gaps = []
    for centre in model.clusterCenters():
        square = F.lit(0.0)
        for i, v in enumerate(centre):
            d = point[i] - F.lit(float(v))
            square = square + d * d
        gaps.append(square)
    # Nearest centre by plain column arithmetic: incomplete rows give NULL and need no join back.
    gaps = F.array(*gaps)
    out = df.withColumn("cluster_id", (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int"))
    complete = F.lit(True)
    for n in columns:
        complete = complete & number(df, n).isNotNull()
    out = out.withColumn("cluster_id", F.when(complete, F.col("cluster_id")))
    summary = {"k": k, "rows": rows, "silhouette": None}
    if silhouette and rows > k:
        scored = model.transform(data)
        if scored.select("cluster_id").distinct().limit(2).count() > 1:
            summary["silhouette"] = ClusteringEvaluator(featuresCol="raw", predictionCol="cluster_id").evaluate(scored)
    return out, summary


def principal_components(df: DataFrame, columns: Sequence[str] | None = None, components: int = 3, keep: Sequence[str] = ()):
    """Scores ``PC1..`` of the standardised complete rows and the explained shares of variance."""
    columns = list(columns or numeric_columns(df))
    components = min(components, len(columns))
    data = _assembled(df, columns, keep)
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(data).transform(data)
    model = PCA(k=components, inputCol="scaled", outputCol="pc").fit(scaled)
    scores = vector_to_array(F.col("pc"))
    out = model.transform(scaled).select(
        *[F.col(quoted(n)) for n in keep], *[scores[i].alias(f"PC{i + 1}") for i in range(components)]
    )
    return out, [float(v) for v in model.explainedVariance]
