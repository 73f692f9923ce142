from stratalog.engine import Engine
from stratalog.streaming import live


def rows_of(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_enter_leave(spark, tmp_path):
    moves = [(1, t, x, 0.0, 0.0) for t, x in enumerate([0.0, 8.0, 9.0, 20.0])]
    schema = "entity long, tick long, x double, y double, z double"
    spark.createDataFrame(moves, schema).coalesce(1).write.parquet(str(tmp_path / "moves"))
    subs = spark.createDataFrame([(7, 10.0, 0.0, 0.0, 5.0)], "sub long, cx double, cy double, cz double, r double")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "moves"))
    got = rows_of(spark, live.enter_leave(stream, subs), "events_out")
    assert sorted((r.sub, r.tick, r.event) for r in got) == [(7, 1, "enter"), (7, 3, "leave")]


def test_rate_limit(spark, tmp_path):
    schema = "sub long, entity long, comp string, tier int, every int, tick long, value double"
    spark.createDataFrame([(1, 1, "x", 1, 2, t, float(t)) for t in (1, 2, 3)], schema).coalesce(1).write.parquet(str(tmp_path / "u"))
    got = rows_of(spark, live.rate_limited(spark.readStream.schema(schema).parquet(str(tmp_path / "u"))), "rates_out")
    assert sorted(r.tick for r in got) == [1, 3]


def test_listen_reads_the_stream(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 50)], "id long, hp long").write.parquet(str(tmp_path / "p"))
    batch = spark.read.parquet(str(tmp_path / "p"))
    e = Engine(spark).register("players", batch, stream=spark.readStream.schema(batch.schema).parquet(str(tmp_path / "p")))
    df = e.query("LISTEN SELECT id FROM players WHERE hp < 10")
    assert df.isStreaming and [r.id for r in rows_of(spark, df, "listen_out")] == [1]
    assert not e.query("SELECT id FROM players").isStreaming


def test_feed(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "id long").coalesce(1).write.parquet(str(tmp_path / "f"))
    seen = []
    q = live.feed(spark.readStream.schema("id long").parquet(str(tmp_path / "f")), lambda df, n: seen.append((n, df.count())), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, 2)]
