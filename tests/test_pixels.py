from pyspark.sql import functions as F

from lakework.functions import tiles
from lakework.operators import cells, layers, pixels
from lakework.operators.layers import KEY
from lakework.operators.relational import count_by, layer_stack


def scene(spark):
    """A raster of 40 x 30 cells in tiles of 16: two bands and a label that follows the first."""
    grid = spark.range(1).select(F.sequence(F.lit(0), F.lit(40 * 30 - 1)).alias("i"))

    def layer(name, fn):
        raster = grid.select(tiles.make_tile(F.transform("i", fn), 40, 30).alias("tile"))
        return layers.to_layer(raster, 16, 16, name)

    first = layer("band_1", lambda i: (i * 7 % 100).cast("double"))
    second = layer("band_2", lambda i: (i % 10).cast("double"))
    label = layer("target", lambda i: F.when(i * 7 % 100 < 50, 0.0).otherwise(1.0))
    return [first, second], label


def test_classification_learns_and_skips_padding(spark):
    bands, label = scene(spark)
    abt = pixels.base_table(bands, label).cache()
    model = pixels.train(abt, ["band_1", "band_2"], folds=2, depths=(1, 2))
    metrics = pixels.cv_metrics(abt, model)
    assert metrics.count() == 2 and metrics.agg(F.max("metric")).first()[0] > 0.99
    scored = pixels.score(model, layer_stack(bands))
    counts = {r["class"]: r["count"] for r in count_by(scored, "prediction", "class").collect()}
    assert sum(counts.values()) == 40 * 30 and set(counts) == {0.0, 1.0}
    tiled = pixels.retile(scored, 16, 16)
    assert tiled.count() == 6
    assert cells.explode_tiles(tiled).where("prediction IS NOT NULL").count() == 1200
    assert layers.to_raster(tiled, "prediction", 48, 32).count() == 1200
    assert tiled.columns == [KEY, "prediction"]


def test_training_does_not_take_the_partitions_of_a_join(spark, monkeypatch):
    """A tree runs tasks per level and partition; small pieces of a shuffle are packed before it grows."""
    bands, label = scene(spark)
    abt = pixels.base_table(bands, label).repartition(200, KEY)
    seen, fit = [], pixels.CrossValidator.fit

    def counted(self, dataset, params=None):
        seen.append(dataset.rdd.getNumPartitions())
        return fit(self, dataset)

    monkeypatch.setattr(pixels.CrossValidator, "fit", counted)
    model = pixels.train(abt, ["band_1", "band_2"], folds=2, depths=(2,))
    assert seen[0] <= spark.sparkContext.defaultParallelism + 1
    assert pixels.cv_metrics(abt, model).first().metric > 0.99
