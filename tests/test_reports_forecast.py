"""Report views, the oracle on the smallest tables, and the forest."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillcast.plans.reports import search_products, top_products

ORACLE_SAMPLE = ["fill_defaults", "material_stats", "category_stats", "loo_encoding", "rolling_means",
                 "ewm_means", "pct_ranks", "label_codes", "time_split", "next_day_rows", "category_summary",
                 "weather_features", "events_ewm", "dedup_first", "master_multiplicity", "format_report", "product_history",
                 "history_from_pairs", "kpi_from_pairs", "filtered_products", "shown_counts", "day_labels"]


def test_search_regex_and_literal(spark):
    df = spark.createDataFrame([("1", "a.b", "x", "y", 1.0, 0), ("2", "axb", "x", "y", 2.0, 0),
                                ("3", None, "x", "y", 3.0, 0)],
                               "material_no string, display_name string, category string, mat_description string, "
                               "predicted_sale double, is_seasonal int")
    assert sorted(r.material_no for r in search_products(df, "A.B").collect()) == ["1", "2"]
    assert sorted(r.material_no for r in search_products(df, "A.B", literal=True).collect()) == ["1"]
    assert [(r.material_no, r.bar_text) for r in top_products(df, 2).collect()] == [("3", "₹3"), ("2", "₹2")]
    df = df.withColumn("soh", F.lit(5.0) - F.col("predicted_sale")).withColumn("is_seasonal", (F.col("material_no") != "2").cast("int"))
    assert [r.material_no for r in search_products(df, in_season="In-Season Only", sort_by="soh").collect()] == ["1", "3"]
    assert [r.material_no for r in search_products(df, in_season="Off-Season Only").collect()] == ["2"]
    with pytest.raises(ValueError):
        search_products(df, in_season="Yes")


def _norm(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("NULL" if (x is None or (isinstance(x, float) and x != x)) else
                        (round(x, 6) if isinstance(x, float) else str(x)) for x in r)
                  for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_oracle_sf0001(spark, name):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    ref = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(ref.columns)
    assert _norm(got) == _norm(ref)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.count() > 0
    assert "total_predicted" in out.columns


def test_out_of_bag_has_as_many_bags_as_trees(spark, monkeypatch):
    from tillcast.catalog import plan
    from tillcast.plans import forecast
    fitted, forest = [], forecast.forest
    monkeypatch.setattr(forecast, "forest", lambda *a, **k: fitted.append(k.get("weight_col")) or forest(*a, **k))
    fc = forecast.Forecast(plan(spark, SF_SMALL), forecast.ForestConfig(num_trees=6, max_depth=2))
    got = fc.oob_r2().first()
    assert fitted == [f"_w{b}" for b in range(6)] and got.n_oob_rows == fc.matrix.where("is_train = 1").count()


def test_bag_weights_are_poisson_and_leave_every_line_out_somewhere(spark):
    from pyspark.sql import functions as F
    from tillcast.plans.forecast import bag_weight, left_out, spare_bag
    bags = 3
    line = F.xxhash64("id")
    f = spark.range(20000).select(line.alias("_line")).withColumn("_spare", spare_bag(F.col("_line"), bags))
    f = f.select("_spare", *[bag_weight(F.col("_line"), F.col("_spare"), b).alias(f"w{b}") for b in range(bags)],
                 *[left_out(F.col("_line"), F.col("_spare"), F.lit(b)).alias(f"o{b}") for b in range(bags)]).toPandas()
    for b in range(bags):
        assert ((f[f"w{b}"] == 0) == f[f"o{b}"]).all()
    assert f[[f"o{b}" for b in range(bags)]].any(axis=1).all()
    taken = f[f._spare.isna()]
    # lines without a spare bag: Poisson(1), given that not all three take them
    assert abs((f._spare.notna()).mean() - (1 - 0.36788) ** 3) < 0.02
    assert set(taken.w0.unique()) >= {0.0, 1.0, 2.0, 3.0} and abs((taken.w0 == 2).sum() / (taken.w0 == 1).sum() - 0.5) < 0.06


def test_deep_forest_keeps_node_ids(spark):
    from tillcast.catalog import plan
    from tillcast.plans.forecast import Forecast, ForestConfig
    deep = Forecast(plan(spark, SF_SMALL), ForestConfig(num_trees=3, max_depth=30, max_memory_mb=32)).metrics().first()
    again = Forecast(plan(spark, SF_SMALL), ForestConfig(num_trees=3, max_depth=30, max_memory_mb=32, node_cache_depth=30)).metrics().first()
    assert deep == again and (deep.num_trees, deep.max_depth, deep.max_memory_mb) == (3, 30, 32) and deep.n_nodes > 1000


def test_forest_end_to_end(spark, tmp_path):
    from tillcast.catalog import plan
    from tillcast.plans.forecast import Forecast, ForestConfig
    fc = Forecast(plan(spark, SF_SMALL), ForestConfig(num_trees=5, max_depth=5))
    m = fc.metrics().first()
    assert m.train_r2 is not None and m.rmse >= 0
    prods = fc.next_day_products()
    pdf = prods.toPandas()
    assert len(pdf) == plan(spark, SF_SMALL).base.select("material_no").distinct().count()
    assert not pdf["predicted_sale"].isna().any()
    assert (pdf["predicted_qty"] >= 0).all()
    imp = fc.importance(20).toPandas()
    assert len(imp) == 20 and imp["importance"].is_monotonic_decreasing
    oob = fc.oob_r2(bags=2).first()
    kpi = fc.kpi_row(bags=2).first()
    assert oob.n_oob_rows == kpi.n_oob_rows == kpi.n_train and kpi.n_train + kpi.n_test == kpi.n_rows
    assert (kpi.num_trees, kpi.max_depth, kpi.n_features) == (5, 5, 141) and kpi.oob_r2 == oob.oob_r2
    # metrics are those of the test pairs; a second forest with the seed is the same
    pairs = fc.test_pairs().toPandas()
    assert m.rmse == pytest.approx(((pairs.actual - pairs.predicted) ** 2).mean() ** 0.5, rel=1e-6)
    again = Forecast(plan(spark, SF_SMALL), ForestConfig(num_trees=5, max_depth=5))
    assert again.metrics().first() == m
    # a day cut by the split is in both series with its full total
    total = {r.invoice_date: r.Predicted for r in fc.daily_predicted().collect()}
    line = [r for r in fc.history_series().collect() if r.series.endswith("predicted")]
    assert {r.invoice_date for r in line} == set(total) and all(r.value == pytest.approx(total[r.invoice_date]) for r in line)
    paths = fc.write_bundle(str(tmp_path / "bundle"))
    assert set(paths) == {"products", "metrics", "daily_actual", "daily_predicted", "split_dates", "context"}


def test_default_forest_is_large():
    from tillcast.plans.forecast import ForestConfig
    assert (ForestConfig().num_trees, ForestConfig().max_depth) == (100, 30)


def test_csv_sink_and_bundle(spark, tmp_path):
    from tillcast.catalog import score_products
    from tillcast.sources.sinks import EXPORT_COLUMNS, write_bundle, write_product_csv
    p = score_products(spark, SF_SMALL)
    path = write_product_csv(p, str(tmp_path / "export"), "2025-03-22", single_file=True)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == EXPORT_COLUMNS and back.count() == p.count()
    paths = write_bundle(str(tmp_path / "bundle"), {"products": p}, {"train_r2": 0.5})
    assert spark.read.parquet(paths["metrics"]).first().train_r2 == 0.5
