"""Lines are joined, split and scored once: no shuffle of the lines for the split, a median
from the staged lines, one pass for the history, vectors kept without disk."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_narrow import COLS, sheets
from tillcast.operators.enrich import soh_median
from tillcast.operators.split import time_split
from tillcast.operators.stage import stage
from tillcast.plans import forecast, train_side
from tillcast.plans.features import FeaturePlan
from tillcast.plans.forecast import Forecast, ForestConfig


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_split_joins_only_the_cut_day(spark):
    rows = [(dt.datetime(2025, 1, 1 + i % 9), i // 2) for i in range(90)] + [(None, 7)]
    df = stage(spark.createDataFrame(rows, "invoice_date timestamp, line int"), "split-lines")
    split = time_split(df, "invoice_date", ["invoice_date", "line"])
    # the one join is that of the cut day's lines with their partitions' offsets
    assert plan_of(split).count("Join ") == 1
    got = [(r.invoice_date or dt.datetime.max, r.line, -r.is_train) for r in split.collect()]
    assert len(got) == 91 and sum(-t for *_, t in got) == 72
    assert max(r[:2] for r in got if r[2] == -1) <= min(r[:2] for r in got if r[2] == 0)


@pytest.mark.parametrize("frac, n", [(0.0, 0), (1.0, 4)])
def test_split_that_leaves_a_side_empty(spark, frac, n):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 1), i) for i in range(3)] + [(None, 3)], "invoice_date timestamp, line int")
    assert time_split(df, "invoice_date", ["invoice_date", "line"], frac).agg(F.sum("is_train")).first()[0] == n
    assert time_split(df.limit(0), "invoice_date", ["invoice_date", "line"], frac).count() == 0


def test_median_is_that_of_the_staged_lines(spark):
    sh = sheets(spark)
    fp = FeaturePlan(sh)
    got = fp.median_soh.first()[0]
    assert "_staged_joined" in vars(fp)   # joined once, for the median and for all else
    assert got == soh_median(sh.sales, sh.sku_buy, sh.indent, sh.crt_size, COLS).first()[0] == 6.0
    assert fp.lines.columns[-1] == "_row" and {r.soh for r in fp.lines.collect()} == {5.0, 6.0, 7.0}
    assert sorted(map(str, fp.filled.collect())) == sorted(map(str, FeaturePlan(sh, staged=False).filled.select(*fp.filled.columns).collect()))


def test_train_side_lines_meet_one_table_each(spark):
    text = plan_of(train_side.train_side_encoding(FeaturePlan(sheets(spark))))
    assert text.index("Union") < text.index("Join")


def test_holdout_errors_read_narrow_lines(spark, monkeypatch):
    seen, real = [], train_side.regression_metrics
    monkeypatch.setattr(train_side, "regression_metrics", lambda df, *a, **k: seen.append(plan_of(df)) or real(df, *a, **k))
    assert train_side.encoding_holdout(FeaturePlan(sheets(spark))).count() == 2
    assert len(seen) == 2 and not any("Join" in s for s in seen)


def test_history_scans_the_scored_lines_once(spark):
    day = [dt.datetime(2025, 1, d) for d in (1, 2, 3)]
    scored = spark.createDataFrame([(day[0], 1, 1.0), (day[1], 1, 2.0), (day[1], 0, 4.0), (day[2], 0, 8.0)], "invoice_date timestamp_ntz, is_train int, prediction double")
    daily = spark.createDataFrame([(d, 5.0) for d in day], "invoice_date timestamp_ntz, day_total double")
    out = forecast.history_series(daily, scored, spark.range(1).select(F.lit(9.0).alias("value")), "2025-01-04")
    assert "prediction#" not in plan_of(out)
    got = sorted((r.series, r.invoice_date.day, r.value) for r in out.collect())
    assert got == [("actual", 1, 5.0), ("actual", 2, 5.0), ("actual", 3, 5.0), ("forecast", 4, 9.0), ("test_predicted", 2, 6.0), ("test_predicted", 3, 8.0),
                   ("train_predicted", 1, 1.0), ("train_predicted", 2, 6.0)]


def test_vectors_are_kept_without_disk(spark):
    runs = []
    for lines in (1, 1000):   # one fit at a time, or several side by side
        f = Forecast(FeaturePlan(sheets(spark)), ForestConfig(num_trees=3, max_depth=2, lines_side_by_side=lines))
        runs.append(sorted(map(str, f.oob_predictions().collect())))
        assert f.matrix.storageLevel.useMemory and not f.matrix.storageLevel.useDisk
        f.matrix.unpersist()
    assert runs[0] == runs[1] and len(runs[0]) == 24
