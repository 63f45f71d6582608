"""Times that stand late in a very long page."""

import datetime as dt

from orrery.plans import queries


def test_the_query_parses_whole_pages(spark, tmp_path):
    html = "<p>" + "word " * 450_000 + "</p><p>Updated on: 2024-01-05 10:00</p>"
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    (row,) = queries.QUERIES["page_times"](spark, str(tmp_path)).collect()
    assert row.modified == dt.datetime(2024, 1, 5, 10)
