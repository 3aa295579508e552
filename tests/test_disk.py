"""What staging leaves on disk: no shuffle files of a write that has ended, no list of
repeated strings that is already judged."""

import os
import time

from pyspark.sql import functions as F

from tests.test_narrow import COLS, sheets
from tillcast.llm import op12_suffix_dedup as op12
from tillcast.operators import joins
from tillcast.operators.split import time_split
from tillcast.operators.stage import CLEANUP, part, release, stage
from tillcast.plans import features
from tillcast.plans.features import FeaturePlan
from tillcast.plans.forecast import Forecast, ForestConfig, assembled


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_stage_deletes_what_it_shuffled(spark):
    before, was = shuffled(spark), spark.conf.get(CLEANUP, None)
    out = stage(spark.range(50000).repartition(5).groupBy(F.col("id") % 7).count(), "disk")
    for _ in range(50):
        if not shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffled(spark) - before
    assert out.agg(F.sum("count")).first()[0] == 50000 and spark.conf.get(CLEANUP, None) == was


def test_part_of_a_staged_table_can_be_released(spark):
    table = stage(spark.range(10).withColumn("k", F.col("id") % 2), "parts", "k")
    own = part(table, "k", "1")
    release(own, table.where("false"))   # what is not staged is left alone
    assert not os.path.exists(own._staged_path.removeprefix("file:")) and [r.id for r in part(table, "k", "0").sort("id").collect()] == [0, 2, 4, 6, 8]


def test_lists_go_as_they_are_judged(spark, monkeypatch):
    held, left, real = [], [], op12.stage
    folders = lambda df: [x for x in os.listdir(df._staged_path.removeprefix("file:")) if x.startswith("round=")]

    def staged(df, name, by=None):
        if name == "suffixes-settled":
            left.extend(folders(held[0]))
        out = real(df, name, by)
        held.append(out)
        return out
    monkeypatch.setattr(op12, "stage", staged)
    monkeypatch.setattr(op12, "BUCKET", 400)
    text = " ".join(f"word{i * i}" for i in range(400))
    docs = spark.createDataFrame([(1, text), (2, "other start " + text[300:900]), (3, "short"), (None, text)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in op12.remove_repeats(docs).collect()}
    assert got == {1: text.encode(), 2: b"other start ", 3: b"short", None: text.encode()}
    assert left == ["round=-1"]


def test_steps_go_with_their_result(spark):
    fp = FeaturePlan(sheets(spark))
    kept = sorted((r.material_no, r.MatAvg_rank) for r in fp.M.collect())
    root = os.path.dirname(fp.ranks._staged_path.removeprefix("file:"))
    mine = os.path.getmtime(fp.lines._staged_path.removeprefix("file:"))
    left = [x for x in os.listdir(root) if x.startswith(("ranged-", "large-groups-", "median-brackets-")) and os.path.getmtime(f"{root}/{x}") >= mine]
    assert len(kept) == 3 and not left


def test_lines_are_shuffled_to_their_statistics_in_parts(spark, monkeypatch):
    want = sorted(map(str, (f := FeaturePlan(sheets(spark)).fact).drop("_row").collect()))
    monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", 0)
    seen, real = [], features.stage
    monkeypatch.setattr(features, "stage", lambda df, name, *a, more=(), **k: seen.append((name, len(more))) or real(df, name, *a, more=more, **k))
    got = FeaturePlan(sheets(spark)).fact
    assert ("features", features.FACT_ROUNDS - 1) in seen and set(got.columns) == set(f.columns)
    assert sorted(map(str, got.select(*[c for c in f.columns if c != "_row"]).collect())) == want and len(want) == 30
    assert got.select("_row").distinct().count() == 30


def test_split_by_address_moves_no_line(spark):
    rows = [(i // 4, i % 2, i) for i in range(50)] + [(0, None, 50)] * 3 + [(None, 1, 51)]
    df = stage(spark.createDataFrame(rows, "day int, line int, x int").withColumn("_row", F.monotonically_increasing_id()), "addressed-split")
    for frac in (0.0, 0.05, 0.5, 0.8, 1.0):
        got = time_split(df, "day", ["day", "line"], frac, address="_row")
        assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
        key = lambda r: (r.day is None, r.day or 0, r.line is not None, r.line or 0)
        lines = got.collect()
        train, test = ([key(r) for r in lines if r.is_train == side] for side in (1, 0))
        assert len(lines) == 54 and len(train) == int(54 * frac) and (not train or not test or max(train) <= min(test))


def test_vectors_come_from_one_array(spark):
    fp = FeaturePlan(sheets(spark))
    m = assembled(fp)
    assert "named_struct" not in m._jdf.queryExecution().optimizedPlan().toString().split("Project", 2)[1]
    assert {len(r.features) for r in m.collect()} == {len(fp.feature_names)}
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_next_day_products_read_the_last_lines_features_once(spark):
    f = Forecast(FeaturePlan(sheets(spark)), ForestConfig(num_trees=2, max_depth=2))
    plan = f.next_day_products()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_to_vector") <= 1 and plan.count("last-features") <= 1
    assert f.next_day_products().count() == 3
    f.matrix.unpersist()
