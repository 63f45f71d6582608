"""Vendor rows and stored answers."""

from pyspark.sql import functions as F

from orrery.functions import rows


def test_vendor_rows(spark):
    universe = spark.createDataFrame([("abc", "Abc Inc"), ("", "x"), (None, "y")], "Code string, Name string")
    assert [tuple(r)[:3] for r in rows.universe_rows(universe, "nyse").collect()] == [("ABC", "ABC.NYSE", "Abc Inc")]
    bars = spark.createDataFrame([("a", "2024-01-02", "1.5", "bad", "NaN"), ("a", "no", "1", "1", "1")], "ticker string, Date string, Open string, close string, volume string")
    got = rows.bar_rows(bars).collect()
    assert len(got) == 1 and (got[0].symbol, got[0].open, got[0].close, got[0].volume, got[0].adjusted_close) == ("A", 1.5, None, None, None)
    caps = spark.createDataFrame([("a", "2024-01-02", "5"), ("a", "2024-01-03", None)], "ticker string, date string, marketCap string")
    assert [r.market_cap for r in rows.market_cap_rows(caps).collect()] == [5.0]


def test_stored_answers(spark):
    f = spark.createDataFrame([("2024-01-02", "A", "A.NYSE", "T", "body http://x.y", "l", "f", 3, "p", "Long.")], "date string, symbol string, source_ticker string, title string, content string, link string, source_file string, source_row int, prompt string, response_raw string")
    got = rows.response_rows(f, 5, keep_news=True).first()
    assert (got.response_label, got.response_parsed_ok, got.news_char_len, got.truncated_news) == ("YES", True, 7, "T\n\nbo")
    extra = f.withColumns({"tags": F.array(F.lit("x")), "sentiment": F.lit(None).cast("map<string,double>"), "raw_symbols": F.array(F.lit("A"))})
    assert rows.metadata_rows(extra, True).first().text == "T\n\nbody"
    assert rows.audit_rows(f).count() == 1
    news = extra.withColumn("symbols", F.array(F.lit(" a "), F.lit("")))
    assert rows.article_rows(news).first().raw_symbols == ["A"]
