"""Write the formatted physical plans of representative queries to docs/plans/.

usage: python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

QUERIES = ["enrich_left_joins", "loo_encoding", "material_stats", "events_ewm", "rolling_means", "pct_ranks", "time_split",
           "category_summary", "feature_matrix", "last_row_per_material", "split_masters", "weather_by_date"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from tillcast import catalog
    from tillcast.session import get_spark
    spark = get_spark("local[8]", 16)
    out_dir = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "plans")
    os.makedirs(out_dir, exist_ok=True)
    for name in QUERIES:
        df = catalog.CATALOG[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()   # final adaptive plan
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain(mode="formatted")
        text = re.sub(r"file:[^\]\s,]*tillcast-stage/", "<checkpoint>/tillcast-stage/", buf.getvalue())
        text = re.sub(r"file:/root/testdata/[^\]\s,]*", "<tables>", text)
        with open(os.path.join(out_dir, f"{name}.txt"), "w") as fh:
            fh.write(text)
        print(name, "ok")


if __name__ == "__main__":
    main()
