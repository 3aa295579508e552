"""Operator 2 tears only groups whose bytes no shard could hold; operator 4 takes suffixes as a parameter."""

import random

from tillcast.llm import op2_sharding, op4_url_filters


def test_many_empty_texts_stay_in_one_shard(spark):
    rng = random.Random(1)
    rows = [(i, "") for i in range(300)] + [(300 + i, "".join(rng.choice("abc ") for _ in range(rng.randint(200, 900)))) for i in range(1700)]
    big = "x" * 4000
    rows += [(5000 + i, big) for i in range(80)]  # a quarter of the bytes
    got = op2_sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).toPandas()
    assert got[got.doc_id < 300].shard.nunique() == 1 and got[got.doc_id >= 5000].shard.nunique() > 1
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() < 1.05 * size.mean()


def test_suffixes_are_a_parameter(spark):
    pages = spark.createDataFrame([(1, "http://a.x.github.io/1"), (2, "http://b.x.github.io/"), (3, "http://c.y.github.io/"), (4, None), (5, "http://a.x.github.io/2")], "page_id long, url string")
    outcomes = spark.createDataFrame([("a.x.github.io", 1)] * 20 + [("d.y.github.io", 0)] * 20, "host string, bad int")
    one = {r.page_id: r.rate for r in op4_url_filters.judge(pages, outcomes).collect()}
    two = {r.page_id: r.rate for r in op4_url_filters.judge(pages, outcomes, two_labels=["github.io"]).collect()}
    assert one[2] == one[3] and two[2] > two[3] and one[1] == one[5] and set(one) == {1, 2, 3, 4, 5}
