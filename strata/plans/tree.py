"""Decision-tree classification (Gini, continuous features) on Spark ML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectorize(df: DataFrame, col: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    if dict(df.dtypes)[col].startswith("array"):
        return df.withColumn(col, array_to_vector(F.col(col).cast("array<double>")))
    return df


def tree_fit(df: DataFrame, num_classes: int, max_depth: int = 5, max_bins: int = 32, label_col: str = "label",
             features_col: str = "features", seed: int = 42):
    """Train a Gini classification tree; all features continuous."""
    from pyspark.ml.classification import DecisionTreeClassifier

    if num_classes < 2:
        raise ValueError("num_classes must be >= 2")
    data = _vectorize(df, features_col).withColumn(label_col, F.col(label_col).cast("double"))
    bad = data.filter((F.col(label_col) < 0) | (F.col(label_col) >= num_classes)).limit(1).count()
    if bad:
        raise ValueError(f"labels must lie in [0, {num_classes})")
    clf = DecisionTreeClassifier(impurity="gini", maxDepth=max_depth, maxBins=max_bins, labelCol=label_col,
                                 featuresCol=features_col, seed=seed)
    return clf.fit(data)


def tree_predict(model, df: DataFrame, label_col: str = "label", features_col: str = "features") -> DataFrame:
    data = _vectorize(df, features_col)
    out = model.transform(data)
    keep = [c for c in df.columns if c != features_col]
    return out.select(*keep, F.col("prediction").cast("double").alias("prediction"))


def test_error(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """Fraction of rows whose prediction differs from the label (one row)."""
    return pred.agg(F.avg((F.col(label_col).cast("double") != F.col(pred_col).cast("double")).cast("double"))
                    .alias("test_error"))


def tree_dump(model) -> list[str]:
    """The readable rules, one line each (the model is small and lives on the driver)."""
    return model.toDebugString.splitlines()
