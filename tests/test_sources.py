import base64
import json
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakework.operators import quantiles, relational
from lakework.sources import files, jdbc, keyvalue


def test_csv_names_by_position(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("plant,height\nbirch,14\nheather,1\nlinden,22\n")
    df = files.read_csv(spark, str(path), header=True, names=["n", "a"])
    assert df.dtypes == [("n", "string"), ("a", "string")] and df.count() == 3


def test_rows_with_and_without_schema(spark):
    rows = [("oslo", "fjord"), ("bern", "lake")]
    assert files.rows_to_df(spark, rows, ["city", "water"]).columns == ["city", "water"]
    assert files.rows_to_df(spark, rows).columns == ["_1", "_2"]


def test_verify_finds_repeated_rows(spark, tmp_path):
    rows = spark.range(10_000).selectExpr("id + 1 a", "cast(id - 2 as string) b")
    report = files.overwrite_and_verify(rows, str(tmp_path / "t"), "a").first()
    assert report.ok and report.written == report.read == 10_000


def test_properties(spark, tmp_path):
    path = tmp_path / "job.conf"
    path.write_text("# note\na = 1\nb=x=y\n\n! other\n")
    assert files.load_properties(spark, str(path), {"a": "0", "c": "2"}) == {"a": "1", "b": "x=y", "c": "2"}
    assert files.load_properties(spark, str(tmp_path / "none"), {"c": "2"}) == {"c": "2"}


def test_ranges_cover_each_key_once(spark):
    predicates = jdbc.range_predicates("id", 0, 1050, 100)
    assert len(predicates) == 11 and predicates[-1] == "id >= 1000"
    hits = sum(F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in predicates)
    keys = spark.range(-500, 3000).unionAll(spark.sql("SELECT cast(NULL AS bigint) AS id"))
    assert [r.n for r in keys.select(hits.alias("n")).distinct().collect()] == [1]
    assert jdbc.range_predicates("id", 5, 7, 100) == ["1 = 1"]
    with pytest.raises(ValueError):
        jdbc.range_predicates("id", 0, 1, 0)


def test_jdbc_options():
    options = jdbc.jdbc_options("jdbc:x", query="SELECT 1", fetchsize=1000)
    assert options == {"url": "jdbc:x", "dbtable": "(SELECT 1) temp", "fetchsize": "1000"}
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x", table="t", query="SELECT 1")


class _Writer:
    def __init__(self):
        self.seen = {}

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.seen[name] = kwargs or args
            return self

        return call


def test_jdbc_write_settings():
    writer = _Writer()
    jdbc.write_jdbc(type("Frame", (), {"write": writer})(), "jdbc:x", "t", column_types="name VARCHAR(64), age INT")
    assert writer.seen["options"] == {
        "url": "jdbc:x", "dbtable": "t", "batchsize": "100000", "numPartitions": "8",
        "createTableColumnTypes": "name VARCHAR(64), age INT",
    }
    assert writer.seen["mode"] == ("append",)


CELLS = json.dumps(
    {
        "rowkey": "rowkey",
        "columns": {
            "plot": {"cf": "rowkey", "col": "rowkey", "type": "string"},
            "crop": {"cf": "field", "col": "sown", "type": "String"},
            "soil": {"cf": "field", "col": "ground", "type": "String"},
        },
    }
)


def test_wide_columns(spark):
    rows = [(f"plot-{n}", "field", q, f"{q} {n}") for n in range(12) for q in ("sown", "ground")]
    cells = spark.createDataFrame([*rows, ("plot-3", "other", "sown", "x")], "rowkey string, cf string, col string, value string")
    wide = keyvalue.kv_read(cells, CELLS)
    assert wide.columns == ["plot", "crop", "soil"] and wide.count() == 12
    assert wide.where("plot = 'plot-3'").first().crop == "sown 3"
    back = keyvalue.kv_write(wide, CELLS)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_newest_cell_version_wins(spark):
    cells = spark.createDataFrame(
        [("k", "field", "sown", "new", 2), ("k", "field", "sown", "old", 1), ("k", "field", "ground", "only", 1)],
        "rowkey string, cf string, col string, value string, ts long",
    )
    assert tuple(keyvalue.kv_read(cells, CELLS).first()) == ("k", "new", "only")


def test_range_pushdown_switches(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "cast(id as string) firm").write.parquet(path)
    catalog = json.dumps({"columns": {"id": {"col": "id", "type": "long"}, "firm": {"col": "firm", "type": "string"}}})

    def pushed(**switches):
        df = keyvalue.apply_catalog(spark.read.parquet(path), catalog, **switches).where("id > 4 AND firm < '8'")
        assert df.count() == 3
        return re.search(r"PushedFilters: \[(.*?)\]", df._jdf.queryExecution().executedPlan().toString()).group(1)

    assert "GreaterThan(id,4)" in pushed() and "LessThan(firm,8)" in pushed()
    assert "GreaterThan(id,4)" not in pushed(push_down_range_long=False)
    assert "LessThan(firm,8)" not in pushed(push_down_range_string=False)


def test_statements_are_cut_outside_quotes_and_comments(spark):
    script = "SELECT ';' AS a; -- no; cut\n/* not; here */ SELECT \"it's; fine\" AS b, 'don\\'t;' AS c;\n-- end;\n"
    assert len(list(relational.split_statements(script))) == 2
    assert tuple(relational.run_statements(spark, [script]).first()) == ("it's; fine", "don't;")
    encoded = base64.b64encode(b"SELECT 1 AS x; SELECT 2 AS x").decode()
    assert relational.run_statements(spark, [encoded], base64=True).first().x == 2
    with pytest.raises(ValueError):
        relational.run_statements(spark, [" -- nothing\n"])


@pytest.mark.parametrize("shape", ["normal", "hot", "heavy", "constant", "wide", "tiny"])
def test_quantiles_equal_numpy(spark, shape):
    rng = np.random.default_rng(7)
    data = {
        "normal": rng.normal(size=5000),
        "hot": np.where(rng.random(6000) < 0.34, 3.5, rng.normal(size=6000)),
        "heavy": np.exp(rng.normal(size=4000) * 12),
        "constant": np.full(100, 2.0),
        "wide": np.array([-1.7e308, -1.0, 0.0, 1e-300, 1.0, 1.7e308]),
        "tiny": np.array([0.0, 5e-324, 1e-323, 1.5e-323]),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in data] + [(None,), (float("nan"),)], "v double")
    probabilities = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, "v", probabilities)
    ordered = np.sort(data)
    for p, value in zip(probabilities, got):
        place = p * (len(data) - 1)
        low, high = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
        assert value == low + (high - low) * (place - np.floor(place)) or (np.isinf(high - low) and low <= value)


def test_quantiles_of_any_spread_take_few_passes(spark, monkeypatch):
    """Values over 600 decades: the passes depend on the rows, not on the values."""
    monkeypatch.setattr(quantiles, "_FEW", 200)
    rng = np.random.default_rng(11)
    data = 10.0 ** rng.uniform(-300, 300, 20_000)
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    passes = []
    for name in ("_cut_points", "_tell", "_narrow"):
        plain = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda *a, plain=plain, name=name: passes.append(name) or plain(*a))
    (median,) = quantiles.exact_quantiles(df, "v", [0.5])
    assert median == pytest.approx(np.median(data), rel=1e-12) and 1 + len(passes) <= 5


def test_infinite_values_have_no_quantiles(spark):
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(spark.createDataFrame([(float("inf"),), (1.0,)], "v double"), "v", [0.5])


def test_histogram_counts_everything(spark):
    df = spark.range(1000).selectExpr("cast(id as double) v")
    rows = quantiles.cell_histogram(df, "v", 10).collect()
    assert sorted((r.bin, r.n) for r in rows) == [(i, 100) for i in range(10)]
    assert quantiles.cell_histogram(df.where("v < 0"), "v", 10).count() == 0


def test_library_has_no_unbounded_gathering():
    """Results reach the driver only where a comment or name bounds them; no local checkpoints, no cross joins."""
    root = Path(__file__).resolve().parents[1] / "lakework"
    allowed = {
        "sources/layers.py": 2, "operators/relational.py": 1, "operators/upsert.py": 3, "operators/areas.py": 1, "operators/changes.py": 1, "operators/quantiles.py": 3, "operators/resample.py": 1,
    }
    for path in root.rglob("*.py"):
        text = path.read_text()
        name = str(path.relative_to(root))
        if name.startswith("llm/"):
            continue
        assert "coalesce(1)" not in text and "tempfile" not in text, name
        assert text.count(".collect()") == allowed.get(name, 0), name
        assert "localCheckpoint" not in text and "crossJoin" not in text and "toPandas" not in text


def test_many_classes_of_one_column(spark):
    rng = np.random.default_rng(5)
    data = np.round(rng.normal(size=20_000) * 1000)
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    breaks = quantiles.quantile_breaks(df, "v", 256)
    assert np.allclose(breaks, np.quantile(data, [i / 256 for i in range(1, 256)]))
    classed = df.select("v", quantiles.classify("v", breaks).alias("class")).toPandas()
    assert (classed["class"].to_numpy() == np.searchsorted(breaks, data, side="left")).all()


def test_json_rows_of_mixed_texts(spark):
    texts = ['{"k": 1, "VARIANT": {"OBJECT": 2}}', '{"k": "x", "a VARIANT": [1, "y"]}', "[1]", '[{"k": 5}]', "5", '"x"', "{bro", "null", None]
    rows = files.json_rows_to_df(spark.createDataFrame([(t,) for t in texts], "t string"))
    got = [r.asDict(recursive=True) for r in rows.collect()]
    assert sorted(rows.columns) == ["VARIANT", "a VARIANT", "k"] and len(got) == len(texts)
    assert got[0] == {"k": "1", "VARIANT": {"OBJECT": 2}, "a VARIANT": None}
    assert got[1]["k"] == "x" and got[1]["VARIANT"] is None and got[1]["a VARIANT"] == ["1", "y"]
    assert all(v is None for r in got[2:] for v in r.values())
    none = files.json_rows_to_df(spark.createDataFrame([("5",), ("{}",), ("x",)], "t string"))
    assert none.collect() == [(None,)] * 3
    assert files.json_rows_to_df(spark.createDataFrame([], "t string")).count() == 0
