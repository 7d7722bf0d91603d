"""Per-pixel supervised classification with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakework.operators.cells import explode_tiles, no_data_filter, st_assemble_tile
from lakework.operators.layers import KEY, spatial_join
from lakework.operators.relational import layer_stack
from lakework.session import drop_scratch, scratch_dir


class TileExploder(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage: tiles to one row per cell. Absent tile columns are left out, as when scoring."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None) -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return explode_tiles(dataset, [c for c in self.getInputCols() if c in dataset.columns])


class NoDataFilter(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage: drop cells with NoData in any of the columns that are there."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None) -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return no_data_filter(dataset, [c for c in self.getInputCols() if c in dataset.columns])


def base_table(bands: Sequence[DataFrame], labels: DataFrame) -> DataFrame:
    """Band layers and the label layer on one grid, tiles side by side."""
    return spatial_join(layer_stack(bands), labels)


def pixel_table(bands: Sequence[DataFrame], labels: DataFrame) -> DataFrame:
    """One row per labelled pixel with all its band values."""
    return explode_tiles(base_table(bands, labels)).dropna()


_FOLD = "_fold"


def pixel_estimator(bands: Sequence[str], label: str, max_depth: int = 5, seed: int = 42) -> Pipeline:
    """Explode tiles, drop NoData, assemble the bands, grow a decision tree."""
    columns = [*bands, label]
    return Pipeline(
        stages=[
            TileExploder(inputCols=columns),
            NoDataFilter(inputCols=columns),
            VectorAssembler(inputCols=list(bands), outputCol="features"),
            DecisionTreeClassifier(labelCol=label, featuresCol="features", maxDepth=max_depth, seed=seed),
        ]
    )


def train(
    abt: DataFrame,
    bands: Sequence[str],
    label: str = "target",
    folds: int = 4,
    depths: Sequence[int] = (),
    seed: int = 42,
    parallelism: int = 2,
) -> CrossValidatorModel:
    """Cross-validate on F1 over tree depths; without depths the default tree is validated alone.

    The fold of a tile is a hash of its key, so the pixels of one tile never train and test
    at once, and the folds do not depend on the partitions. The table is written first and dropped
    again: every level of every tree runs a task per partition, and each task reports to the driver on
    all that its lineage holds, so a tree grows over partitions of files, not over those of a join.
    """
    spark = abt.sparkSession
    fold = F.pmod(F.xxhash64(f"{KEY}.col", f"{KEY}.row"), F.lit(folds)).cast("int")
    table, path = abt.select(KEY, *bands, label, fold.alias(_FOLD)), scratch_dir(spark, "training")
    pipeline = pixel_estimator(bands, label, seed=seed)
    tree = pipeline.getStages()[-1]
    grid = ParamGridBuilder()
    if depths:
        grid = grid.addGrid(tree.maxDepth, list(depths))
    evaluator = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="f1")
    validator = CrossValidator(
        estimator=pipeline, estimatorParamMaps=grid.build(), evaluator=evaluator, numFolds=folds, seed=seed,
        parallelism=parallelism, foldCol=_FOLD,
    )
    try:
        table.write.parquet(path)
        return validator.fit(spark.read.schema(table.schema).parquet(path))
    finally:
        drop_scratch(spark, path)


def cv_metrics(df: DataFrame, model: CrossValidatorModel) -> DataFrame:
    """Parameter settings and their mean metric; ``df`` only lends its session."""
    rows = [
        (", ".join(f"{p.name} = {v}" for p, v in params.items()), float(metric))
        for params, metric in zip(model.getEstimatorParamMaps(), model.avgMetrics)
    ]
    return df.sparkSession.createDataFrame(rows, "params string, metric double")


def score(model: CrossValidatorModel, layer: DataFrame) -> DataFrame:
    """Predict every data pixel of a layer. Padding is NoData, so it gets no class."""
    return model.bestModel.transform(layer)


def retile(scored: DataFrame, cols: int, rows: int) -> DataFrame:
    """Predictions back in tiles."""
    return st_assemble_tile(
        scored.withColumn("prediction", F.col("prediction").cast("double")),
        [KEY], "column_index", "row_index", "prediction", cols, rows, cell_type="int",
    )
