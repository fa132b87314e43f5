"""The factorised router: texts and features meet the two routing arms in a space of few dimensions.

A row's vector is projected, and the projection is compared with what prefers the deep arm and what prefers the fast
one. All of it is linear, so it folds to one weight for each component, kept as a table and applied as a dot product.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.columns import r4
from vigil.operators import routing as V

#: Values from which an action is of high value, and from which tools or retries are out of the ordinary (fixed values).
HIGH_VALUE, MANY_TOOLS, MANY_RETRIES = 50_000, 5, 3
TABLE = "component int, weight double"


def routing_document(rows: DataFrame) -> Column:
    """What the router reads of an interaction: its texts, what it does, and flags for what stands out."""
    action, amount = F.coalesce("action_type", F.lit("")), F.coalesce(F.col("amount"), F.lit(0.0))
    flags = F.concat_ws(
        " ", F.when(amount >= HIGH_VALUE, "high_value_action"), F.when((F.col("tool_calls") >= MANY_TOOLS) | (F.col("retry_count") >= MANY_RETRIES), "operational_anomaly"),
        F.when(~action.isin("information", "informational", "none", ""), "side_effecting_action"),
    )
    meta = F.concat(F.lit("action="), action, F.lit(" amount="), F.format_string("%.0f", amount), F.lit(" tools="), F.col("tool_calls").cast("string"), F.lit(" retries="), F.col("retry_count").cast("string"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(F.lit("[prompt] "), text("prompt"), F.lit(" [response] "), text("response"), F.lit(" [meta] "), meta, F.lit(" [flags] "), F.coalesce(F.nullif(flags, F.lit("")), F.lit("none")))


@dataclass(frozen=True)
class Factors:
    """Projection (components x latent), what each arm prefers in the latent space, and a bias."""

    projection: np.ndarray
    deep: np.ndarray
    fast: np.ndarray
    bias: float

    def folded(self) -> np.ndarray:
        return self.projection @ (self.deep - self.fast)

    def two_sided(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of vectors by the definition, arm against arm."""
        q = x @ self.projection
        return 1 / (1 + np.exp(-(q @ self.deep - q @ self.fast + self.bias)))

    def table(self, spark: SparkSession) -> DataFrame:
        """The folded weights as rows; the bias is component -1."""
        rows = [(-1, float(self.bias)), *((i, float(w)) for i, w in enumerate(self.folded()))]
        return spark.createDataFrame(rows, TABLE)


def fit(rows: DataFrame, vector: Column, label: Column, latent: int = 16, steps: int = 30) -> Factors:
    """Project on the ``latent`` directions along which the vectors vary most, then learn what tells the arms apart there.

    Rows without a label are left out. The two arms share the learned difference equally.
    """
    data = rows.select(array_to_vector(vector).alias("x"), label.cast("double").alias("label")).filter("label is not null")
    width = data.select(F.size(vector_to_array("x"))).first()[0]
    latent = min(latent, width)
    pca = PCA(k=latent, inputCol="x", outputCol="features").fit(data)
    model = LogisticRegression(maxIter=steps, regParam=0.01).fit(pca.transform(data).select("features", "label"))
    half = model.coefficients.toArray() / 2
    return Factors(np.array(pca.pc.toArray()), half, -half, float(model.intercept))


def weights_of(table: DataFrame) -> tuple[list[float], float]:
    """(weights by component, bias) of a stored table: as many numbers as a vector has components."""
    held = {r["component"]: r["weight"] for r in table.collect()}
    return [held[i] for i in range(len(held) - 1)], held[-1]


def linear_score(vector: Column, weights: Sequence[float], bias: float) -> Column:
    """Sigmoid of the dot product with the folded weights."""
    products = F.zip_with(vector, F.array(*map(F.lit, weights)), lambda a, b: a * b)
    z = F.aggregate(products, F.lit(float(bias)), lambda s, x: s + x)
    return 1 / (1 + F.exp(-z))


def features_vector(rows: DataFrame, action: Column | None = None) -> Column:
    """The nine routing features as one vector, in their fixed order."""
    found = V.features(F.col("prompt"), F.col("response"), F.col("context"), action)
    return F.array(*(found[k].cast("double") for k in V.WEIGHTS))


def cascade(turns: DataFrame, score: Column, profile: str = "default", action: Column | None = None) -> DataFrame:
    """The cascade with ``score`` in the place of the fixed complexity (a column of ``turns``, 0 to 1)."""
    return V.rerouted(V.cascade(turns, profile, action).withColumn("complexity", r4(score, 6)))
