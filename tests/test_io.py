"""Files, data sources, sinks and streams."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.sources import files, rest, sinks
from orrery.streaming import shards


def write_news(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows) + "\n")


def article(k, date="2024-01-02T03:00:00Z"):
    return {"symbol": "A", "date": date, "title": f"t{k}", "content": "c" * k, "link": f"l{k % 3}", "tags": ["x"], "sentiment": {"pos": 0.5}, "raw_symbols": ["A"]}


def test_news_files(spark, tmp_path):
    write_news(tmp_path, "news_0.jsonl", [article(1), "{broken", article(2, "2024-02-02T00:00:00Z"), article(3, "no date")])
    assert files.news(spark, str(tmp_path)).count() == 3
    got = files.news(spark, str(tmp_path), "2024-01-01", "2024-01-31").collect()
    assert [r.title for r in got] == ["t1"] and got[0].sentiment == {"pos": 0.5}


def test_rows_of_news_files_are_numbered_across_blocks(spark, tmp_path):
    lines = {"a.jsonl": [], "b.jsonl": ["", "no json", json.dumps({"title": "b2", "date": "2024-01-01"})]}
    lines["a.jsonl"] = [json.dumps({"title": f"a{k}", "content": "x" * (k % 50)}) for k in range(400)]
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = files.news(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.title: r.source_row for r in got} == {**{f"a{k}": k for k in range(400)}, "b2": 2} and len(got) == 401


def test_bar_files_and_shards(spark, tmp_path):
    for exchange, ticker in (("NYSE", "A"), ("NASDAQ", "B")):
        (tmp_path / exchange).mkdir()
        pd.DataFrame({"date": ["2024-01-02"], "close": [1.0]}).to_parquet(tmp_path / exchange / f"{ticker}.parquet")
    assert {(r.stem, r.exchange) for r in files.bars(spark, str(tmp_path)).collect()} == {("A", "NYSE"), ("B", "NASDAQ")}
    assert files.bars(spark, str(tmp_path), ["NYSE"]).count() == 1
    assert files.sharded(spark, str(tmp_path), "A.parquet").count() == 1


def test_ticker_lists(spark, tmp_path):
    (tmp_path / "t.txt").write_text("A.NYSE,x\n# all\n\n B # c\n")
    (tmp_path / "t.csv").write_text("Name\tSymbol\nx\tA\ny\t\n")
    (tmp_path / "t.json").write_text(json.dumps(["A", {"ticker": "B"}, {"Code": "C"}]))
    names = lambda f: sorted(r.ticker for r in f.collect())
    assert names(files.tickers_from_text(spark, str(tmp_path / "t.txt"))) == ["A.NYSE", "B"]
    assert names(files.tickers_from_csv(spark, str(tmp_path / "t.csv"), "\t")) == ["A"]
    assert names(files.tickers_from_json(spark, str(tmp_path / "t.json"))) == ["A", "B", "C"]
    with pytest.raises(ValueError):
        files.tickers_from_csv(spark, str(tmp_path / "t.csv"), "\t", names=("nope",))


def test_pairs_must_match(spark):
    left, right = (spark.createDataFrame([("f", k) for k in r], "source_file string, source_row int") for r in (range(3), range(2)))
    assert files.paired(left, left).count() == 3
    with pytest.raises(Exception, match="differ"):
        files.paired(left, right).count()


def fake_fetch(url, params):
    ticker = url.rsplit("/", 1)[1]
    if "offset" in params:
        rows = [{"date": "2024-01-02", "title": f"{ticker}{k}"} for k in range(5)]
        return json.dumps(rows[params["offset"] : params["offset"] + params["limit"]])
    return json.dumps([{"Date": "2024-01-02", "open": "1.5", "close": "bad", "volume": 7}])


def test_rest_source(spark):
    spark.dataSource.register(rest.MarketData)
    options = {"url": "http://x/{ticker}", "tickers": "A,B"}
    rows = rest._Reader(options | {"fetch": "tests.test_io:fake_fetch"})
    got = [r for p in rows.partitions() for r in rows.read(p)]
    assert got[0] == ("A", "2024-01-02", 1.5, None, None, None, None, 7.0) and len(got) == 2
    pages = rest._Pages(options | {"fetch": "tests.test_io:fake_fetch", "limit": "2"})
    at, seen = pages.initialOffset(), []
    while at["ticker"] < 2:
        rows, at = pages.read(at)
        seen += [r[2] for r in rows]
    assert seen == [f"{t}{k}" for t in "AB" for k in range(5)]
    assert [r[2] for r in pages.readBetweenOffsets({"ticker": 0, "row": 2}, {"ticker": 1, "row": 0})] == ["A2", "A3", "A4"]
    assert spark.read.format("market_data").options(**options).load().columns[:2] == ["ticker", "date"]


def test_limits_and_retries():
    now, waits = [0.0], []
    limiter = rest.RateLimiter(60, clock=lambda: now[0], sleep=waits.append)
    limiter.wait(), limiter.wait()
    assert waits == [1.0]
    with pytest.raises(ValueError):
        rest.RateLimiter(0)
    assert rest.RateLimiter(0, lenient=True).gap == 0
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert rest.with_retries(flaky, sleep=lambda s: None) == "done" and len(calls) == 3


def test_vectors_come_in_two_layouts(spark, tmp_path):
    def write(name, **columns):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        pd.DataFrame(columns).to_parquet(tmp_path / name)

    with pytest.raises(FileNotFoundError):
        files.vector_files(spark, str(tmp_path))
    write("s0/responses_0.parquet", source_row=[1, 2], label=["YES", "NO"])
    write("s0/pre_response_embeddings_0.parquet", source_row=[1, 2], vector=[[1.0], [2.0]])
    metadata, vectors = files.vector_files(spark, str(tmp_path))
    assert files.paired(metadata, vectors, ["source_row"]).count() == 2 and "label" in metadata.columns
    write("s1/metadata_0.parquet", source_row=[7], title=["t"])
    write("s1/embeddings_0.parquet", source_row=[7], vector=[[3.0]])
    metadata, vectors = files.vector_files(spark, str(tmp_path))
    assert [r.title for r in metadata.collect()] == ["t"] and [r.vector for r in vectors.collect()] == [[3.0]]


def test_readers_share_the_rate(spark):
    reader = rest._Reader({"tickers": "A,B,C,D,E", "perMinute": "60", "readers": "2"})
    parts = reader.partitions()
    assert [p.tickers for p in parts] == [["A", "C", "E"], ["B", "D"]] and sum(p.per_minute for p in parts) == 60
    assert rest._Reader({"tickers": ""}).partitions() == []


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("NYSE", "A", "2024-01-02", 0.5, None), ("NYSE", "B", "2024-01-02", -0.5, "bad")], "exchange string, symbol string, trade_date string, weight double, reason string")
    sinks.jsonl_shards(f.coalesce(1), str(tmp_path / "j"), 1)
    assert len(list((tmp_path / "j").glob("*.json"))) == 2
    sinks.by_exchange(f, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 2
    sinks.reason_log(f, str(tmp_path / "r"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "r")).count() == 1
    assert sinks.wide_weights(f).first().asDict() == {"trade_date": "2024-01-02", "A": 0.5, "B": -0.5}
    assert json.loads(sinks.metrics_json(f.agg(F.count("*").alias("n")))) == {"n": 2}


def test_stream_takes_each_shard_once(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    write_news(source, "news_00000.jsonl", [article(k) for k in range(4)])
    run = lambda: shards.drain(shards.shard_stream(spark, [str(source)]), out, mark)
    run()
    write_news(source, "news_00001.jsonl", [article(9)])
    run(), run()
    assert spark.read.parquet(out).count() == 5
    labelled = shards.shard_stream(spark, [str(source)]).withColumn("label", F.lit("YES"))
    q = shards.label_counts(labelled).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.news_count for r in spark.table("counts").collect()] == [5]
    q = shards.without_repeats(shards.shard_stream(spark, [str(source)])).writeStream.format("memory").queryName("links").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("links").count() == 3


def test_model_batches_halve():
    sizes = []

    def model(texts):
        sizes.append(len(texts))
        if len(texts) > 2:
            raise MemoryError
        return shards.stub_model(texts)

    frames = list(shards.label_batches(model, 8)(iter([pd.DataFrame({"prompt": ["a", None, "ccc", "d", "e"]})])))
    assert len(frames[0].response_raw) == 5 and max(sizes) == 5
    assert shards.check_producer({"status": "completed"}) and not shards.check_producer({"status": "running", "updated_at": 5}, now=9)
    for bad in ({"status": "failed"}, {"status": "running", "updated_at": 0}):
        with pytest.raises(RuntimeError):
            shards.check_producer(bad, now=5000)
