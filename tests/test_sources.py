"""Tables, messages and the collecting stream."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidebook.plans import catalog
from tidebook.sources import discovery, messages, tables, versions, websocket
from tidebook.streaming import collector


def message(second, price=10.0, levels=2, wrapped=False, long=False):
    bids = [[str(price - i), "1.5"] for i in range(levels)]
    asks = [[str(price + 1 + i), "2.5"] for i in range(levels)]
    body = {"E": 1_700_000_000_000 + second * 1000, "s": "abc", ("bids" if long else "b"): bids, ("asks" if long else "a"): asks}
    return json.dumps({"stream": "x", "data": body} if wrapped else body)


def received(second, ms=0):
    return dt.datetime.fromtimestamp(1_700_000_000 + second + ms / 1000, dt.UTC)


def test_messages_of_all_shapes(spark):
    rows = [(message(0), received(0, 900)), (message(1, wrapped=True), received(1)), (message(2, long=True), received(2)), (message(3, levels=1), received(3)), ("{}", received(4)), ("no json", received(5))]
    got = messages.parse_messages(spark.createDataFrame(rows, "value string, timestamp timestamp"), levels=2).orderBy("timestamp").collect()
    assert [(r["symbol"], r["bid_price_2"], r["ask_size_1"], r["timestamp"].microsecond) for r in got] == [("ABC", 9.0, 2.5, 0)] * 3
    with pytest.raises(Exception, match="lacks"):
        messages.parse_messages(spark.createDataFrame(rows, "value string, timestamp timestamp"), levels=2, strict=True).collect()


def test_schema_is_fixed(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "1.5", "x"), ("2024-01-01 00:00:09", "bad", "y")], "timestamp string, bid_price_1 string, other string")
    got = messages.normalise_schema(df, levels=1).orderBy("timestamp").collect()
    assert "other" not in got[0].asDict()
    assert [(r["bid_price_1"], r["session_id"]) for r in got] == [(1.5, 1), (None, 2)]


def test_stream_saves_days_and_resumes(spark, tmp_path):
    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()

    def put(name, seconds):
        lines = [json.dumps({"received": received(s, m).isoformat(), "message": message(s, price=10 + s + m / 1000)}) for s, m in seconds]
        (folder / name).write_text("\n".join(lines))

    def run():
        # Without repeats in quiet seconds, which would leave no gap.
        collector.wait(*collector.collect(collector.read_folder(spark, str(folder)), table, checkpoint, levels=2, once=True, carry_seconds=1))
        return versions.read(spark, table).orderBy("timestamp").collect()

    put("a.json", [(0, 100), (0, 900), (1, 0), (5, 0)])
    rows = run()
    assert [r["session_id"] for r in rows] == [1, 1, 2]
    put("b.json", [(6, 0), (9, 0), (86_400 * 2, 0)])
    rows = run()
    assert [r["session_id"] for r in rows] == [1, 1, 2, 2, 3, 4]
    assert len({r["dt"] for r in rows}) == 2
    assert versions.current(spark, table).resume("abc") == (4, received(86_400 * 2))
    assert versions.current(spark, str(tmp_path / "none")).resume() == (1, None)


def lines_of(folder, name, seconds):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"received": received(s).isoformat(), "message": message(s, price=10 + s)}) for s in seconds))


def saved(spark, table):
    return [(int(r["timestamp"].replace(tzinfo=dt.UTC).timestamp()) - 1_700_000_000, r["bid_price_1"], r["session_id"]) for r in versions.read(spark, table).orderBy("timestamp").collect()]


def test_quiet_seconds_are_filled_across_batches(spark, tmp_path):
    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    for name, seconds in (("a.json", [0, 1]), ("b.json", [4, 6])):
        lines_of(folder, name, seconds)
        collector.wait(*collector.collect(collector.read_folder(spark, str(folder)), table, checkpoint, levels=2, once=True))
    assert saved(spark, table) == [(0, 10.0, 1), (1, 11.0, 1), (2, 11.0, 1), (3, 11.0, 1), (4, 14.0, 1), (5, 14.0, 1), (6, 16.0, 1)]


def test_a_bounded_run_takes_so_many_samples(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "out")
    lines_of(folder, "a.json", range(4))
    lines_of(folder, "b.json", range(4, 8))
    query, saver = collector.collect(collector.read_folder(spark, str(folder)), table, str(tmp_path / "check"), levels=2, every_seconds=1, limit_samples=5)
    collector.wait(query, saver, 0.5)
    assert saver.done and not query.isActive
    assert [s for s, *_ in saved(spark, table)] == [0, 1, 2, 3, 4]


def test_long_silences_cross_buckets(spark):
    rows = spark.createDataFrame([(message(s), received(s)) for s in (0, 3, 20, 21, 45)], "value string, timestamp timestamp")
    sampled = collector.sample_seconds(messages.parse_messages(rows, levels=2))
    got = collector.carry_forward(sampled, bucket_us=7_000_000).collect()
    assert sorted(r["timestamp"].replace(tzinfo=dt.UTC).timestamp() - 1_700_000_000 for r in got) == list(range(46))


def test_inputs_are_resolved_by_precedence(spark, tmp_path):
    folder = str(tmp_path)
    for name in ("ABC_features_2024-01-01", "ABC_features_merged", "ABC_model_dataset_d1_h5_th0p5", "ABC_model_dataset_d1_h5_th0p5_x", "ABC_logistic_d1_h5_th0p5_x_predictions", "ABC_boosted_d1_h5_th0p5_x_predictions", "ABC_logistic_d2_predictions"):
        spark.range(1).write.parquet(f"{folder}/{name}.parquet")
    find = lambda **given: discovery.name_of(discovery.resolve(spark, folder, "abc", "features", **given))
    assert discovery.resolve(spark, None, "abc", "features", path="p", dataset="merged") == "p"
    assert find(dataset="merged", date="2024-01-01") == "ABC_features_merged.parquet"
    assert find(date="2024-01-01") == "ABC_features_2024-01-01.parquet"
    assert find() in ("ABC_features_merged.parquet", "ABC_features_2024-01-01.parquet")
    with pytest.raises(FileNotFoundError):
        find(date="2024-01-02")
    with pytest.raises(ValueError):
        discovery.resolve(spark, None, "abc", "features")
    dataset = discovery.dataset_of(spark, f"{folder}/ABC_logistic_d1_h5_th0p5_x_predictions.parquet", folder)
    assert discovery.name_of(dataset) == "ABC_model_dataset_d1_h5_th0p5_x.parquet"
    with pytest.raises(FileNotFoundError):
        discovery.dataset_of(spark, f"{folder}/ABC_logistic_d2_predictions.parquet", folder)
    with pytest.raises(FileNotFoundError):
        discovery.model_artifacts(spark, folder, "abc")
    for model in ("logistic", "boosted"):
        tables.write_json(spark, {}, f"{folder}/ABC_{model}_d1_h5_th0p5_x_metrics.json")
    token, found = discovery.model_artifacts(spark, folder, "abc")
    assert token == "d1_h5_th0p5_x" and set(found["boosted"]) == {"metrics", "predictions"}


def test_event_time_form_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"received": received(s, m).isoformat(), "message": message(s)}) for s in range(40) for m in (0, 500)]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    stream = collector.windowed_last(collector.read_folder(spark, str(tmp_path / "in")), levels=2)
    query = stream.writeStream.format("memory").queryName("seconds").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert 20 <= spark.table("seconds").count() <= 40


def test_quiet_seconds_repeat_the_last_message(spark):
    rows = spark.createDataFrame([(message(s), received(s)) for s in (0, 3, 20)], "value string, timestamp timestamp")
    got = collector.carry_forward(collector.sample_seconds(messages.parse_messages(rows, levels=2)), 5)
    assert sorted(r["timestamp"].replace(tzinfo=dt.UTC).timestamp() - 1_700_000_000 for r in got.collect()) == [0, 1, 2, 3, 20]


def test_files_are_found(spark, tmp_path):
    df = spark.range(3)
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        tables.write_parquet(df, str(tmp_path / f"ABC_{day}.parquet"))
    found = tables.daily_files(spark, str(tmp_path), "abc", 2)
    assert [f.rsplit("/", 1)[-1] for f in found] == ["ABC_2024-01-02.parquet", "ABC_2024-01-03.parquet"]
    with pytest.raises(FileNotFoundError):
        tables.daily_files(spark, str(tmp_path), "abc", 4)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        tables.write_parquet(df, str(tmp_path / "ABC_2024-01-01.parquet"))
    assert tables.newest(spark, str(tmp_path)).endswith(".parquet")


def test_small_records_round_trip(spark, tmp_path):
    tables.write_json(spark, {"a": [1, 2]}, str(tmp_path / "r.json"))
    assert tables.read_json(spark, str(tmp_path / "r.json")) == {"a": [1, 2]}
    tables.write_csv(spark.range(2), str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), "id long").count() == 2


def test_a_session_leaves_nothing_behind(spark, monkeypatch):
    from pathlib import Path

    from tidebook import storage

    monkeypatch.setattr(storage, "_left", {})
    made = storage.written(spark.range(5), "some")
    kept = spark.range(3).persist()
    path = Path(storage._leftovers(spark)[0].removeprefix("file://"))
    assert made.count() == 5 and path.exists() and kept.is_cached
    storage.clear(spark)
    assert not path.exists() and kept.storageLevel.useDisk is False


def at(second):
    return F.timestamp_seconds(F.lit(second))


def test_upsert_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "t")
    put = lambda second, v, **given: versions.upsert(spark.range(1).select(at(second).alias("timestamp"), F.lit(v).alias("v2")), path, **given)
    put(0, 1)
    first = put(90_000, 2)
    second = put(0, 3)
    assert sorted(r["v2"] for r in versions.read(spark, path).collect()) == [2, 3]
    assert first.days["1970-01-02"] == second.days["1970-01-02"] and first.days["1970-01-01"] != second.days["1970-01-01"]


def test_readers_see_a_version_as_a_whole(spark, tmp_path):
    """A reader that began before an upsert sees the old rows to its end; a write
    that never commits is seen by nobody; a batch that runs again is void."""
    path = str(tmp_path / "t")
    rows = lambda v: spark.range(50).select(F.timestamp_seconds("id").alias("timestamp"), F.lit(v).alias("x"))
    versions.upsert(rows(1), path, writer="w", batch_id=0)
    before = versions.read(spark, path)
    made = versions.upsert(rows(2), path, writer="w", batch_id=1)
    assert {r["x"] for r in before.collect()} == {1} and {r["x"] for r in versions.read(spark, path).collect()} == {2}
    assert versions.upsert(rows(3), path, writer="w", batch_id=1) == made
    assert versions.upsert(rows(3), path, writer="other", batch_id=1).number == made.number + 1

    def broken(*_):
        raise OSError("no commit")

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(versions, "_commit", broken)
        with pytest.raises(OSError):
            versions.upsert(rows(4), path)
    assert {r["x"] for r in versions.read(spark, path).collect()} == {3} and versions.read(spark, path).count() == 50
    with pytest.raises(FileExistsError):
        versions._commit(spark, path, made)
    versions.upsert(rows(5), path)
    assert len(versions._records(spark, path)) == versions.KEPT


def test_segments_are_recorded_and_taken_once(spark, tmp_path):
    """A stream stopped between segments and started again loses and repeats
    nothing, and a new checkpoint goes on from the table's sessions."""
    folder, table = tmp_path / "in", str(tmp_path / "out")
    clock = iter([received(0), *(received(s) for s in range(12)), received(12), received(13)])
    assert websocket.record((message(s, price=10 + s) if s % 5 else None for s in range(12)), str(folder), 3, lambda: next(clock)) == 9
    names = sorted(p.name for p in folder.iterdir())
    assert len(names) == 4
    held = {n: (folder / n).read_text() for n in names}
    for n in names:
        (folder / n).unlink()
    for n in names:
        (folder / n).write_text(held[n])
        collector.wait(*collector.collect(collector.read_folder(spark, str(folder)), table, str(tmp_path / "check"), levels=2, once=True, carry_seconds=1))
    assert [(s, k) for s, _, k in saved(spark, table)] == [(1, 1), (2, 1), (3, 1), (4, 1), (6, 2), (7, 2), (8, 2), (9, 2), (11, 3)]
    lines_of(folder, "z.json", [30, 31])
    for n in names:
        (folder / n).unlink()
    collector.wait(*collector.collect(collector.read_folder(spark, str(folder)), table, str(tmp_path / "new"), levels=2, once=True, carry_seconds=1))
    assert [(s, k) for s, _, k in saved(spark, table)][-2:] == [(30, 4), (31, 4)]


def test_a_reconnect_clears_what_is_held(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "out")
    lines_of(folder, "a.json", [0, 3])
    mark = json.dumps({"received": received(4, 500).isoformat(), "message": websocket.RECONNECTED})
    (folder / "b.json").write_text(mark)
    lines_of(folder, "c.json", [8, 10])
    for _ in range(3):
        collector.wait(*collector.collect(collector.read_folder(spark, str(folder)), table, str(tmp_path / "check"), symbol="abc", levels=2, once=True))
    assert [(s, k) for s, _, k in saved(spark, table)] == [(0, 1), (1, 1), (2, 1), (3, 1), (8, 2), (9, 2), (10, 2)]


@pytest.mark.parametrize("carry", [None, 4])
def test_stream_equals_batch(spark, tmp_path, carry):
    """Rows of several symbols in three segments, against the batch functions."""
    import random

    rng, folder, table = random.Random(7), tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    lines = []
    for s in sorted(rng.sample(range(120), 60)):
        for k in range(rng.randint(1, 2)):
            body = json.loads(message(s, price=10 + s + k / 4))
            lines.append({"received": received(s, 300 * k).isoformat(), "message": json.dumps(body | {"s": rng.choice(["abc", "xyz"]), "E": body["E"] + k})})
    for i in range(3):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(x) for x in lines[i * len(lines) // 3 : (i + 1) * len(lines) // 3]))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # segments are taken in order of time
    collector.wait(*collector.collect(collector.read_folder(spark, str(folder)), table, str(tmp_path / "check"), levels=2, once=True, carry_seconds=carry))
    parsed = messages.parse_messages(spark.createDataFrame([(x["message"], dt.datetime.fromisoformat(x["received"])) for x in lines], "value string, timestamp timestamp"), levels=2)
    wanted = []
    for symbol in ("ABC", "XYZ"):
        rows = collector.carry_forward(collector.sample_seconds(parsed.where(F.col("symbol") == symbol)), carry)
        wanted += [(symbol, r["timestamp"], r["bid_price_1"], r["event_time"], r["session_id"]) for r in collector.assign_sessions(rows).collect()]
    got = [(r["symbol"], r["timestamp"], r["bid_price_1"], r["event_time"], r["session_id"]) for r in versions.read(spark, table).collect()]
    assert sorted(got) == sorted(wanted) and len(got) > 60


def test_late_seconds_get_their_session(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "out")
    for name, seconds in (("a.json", [0, 1, 9, 10]), ("b.json", [2, 10, 20])):
        lines_of(folder, name, seconds)
        collector.wait(*collector.collect(collector.read_folder(spark, str(folder)), table, str(tmp_path / "check"), levels=2, once=True, carry_seconds=1))
    assert [(s, k) for s, _, k in saved(spark, table)] == [(0, 1), (1, 1), (2, 1), (9, 2), (10, 2), (20, 3)]


def test_a_live_silence_is_filled_by_timers(spark, tmp_path):
    import time

    folder, table = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    query, saver = collector.collect(collector.read_folder(spark, str(folder)), table, str(tmp_path / "check"), levels=2, every_seconds=0.5, live=True, limit_samples=6)
    began = dt.datetime.now(dt.UTC)
    (folder / ".a").write_text(json.dumps({"received": began.isoformat(), "message": message(0)}))
    (folder / ".a").rename(folder / "a.json")
    until = time.monotonic() + 60
    while not saver.done and time.monotonic() < until and query.isActive:
        time.sleep(0.5)
    query.stop()
    rows = versions.read(spark, table).orderBy("timestamp").collect()
    seconds = [int(r["timestamp"].replace(tzinfo=dt.UTC).timestamp()) for r in rows]
    assert len(rows) == 6 and seconds == list(range(seconds[0], seconds[0] + 6)) and {r["session_id"] for r in rows} == {1}


def test_a_message_and_its_numbers_are_read_once(spark):
    """One reading of the text, wrapped or bare, and no function of each pair
    that makes numbers; what counts as readable is as it was."""
    pair = '["1", "2"]'
    texts = [
        f'{{"E": 1, "b": [{pair}], "a": [{pair}]}}',
        f'{{"data": {{"E": 2, "bids": [{pair}], "asks": [["1", "x"]]}}}}',
        f'{{"data": {{"E": 3, "bids": [{pair}], "asks": [{pair}]}}, "E": "bad"}}',
        *(f'{{"E": 4, "b": [{bad}], "a": [{pair}]}}' for bad in ('["1"]', "null", '["1", "2", "3"]', "[]", '["1", null]', f'{pair}, ["a", "b"]')),
        "x",
        None,
        "[1]",
        "null",
        f'{{"E": 9, "b": "q", "bids": [{pair}], "a": [{pair}]}}',
        f'{{"data": 5, "E": 12, "b": [{pair}], "a": [{pair}]}}',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "value string").withColumn("timestamp", F.timestamp_seconds(F.lit(5)))
    rows = messages.parse_messages(df, levels=1, symbol="q")
    assert sorted(int(r["event_time"].timestamp() * 1000) for r in rows.collect()) == [1, 3, 9, 12]
    assert {tuple(r)[4:] for r in rows.collect()} == {(1.0, 2.0, 1.0, 2.0)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "transform(" not in plan


def test_filling_parses_messages_once(spark):
    plan = catalog.QUERIES["sampler_carry_forward"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().withCachedData().toString()
    assert "from_json" not in plan.split("InMemoryRelation")[0] and plan.count("InMemoryRelation") == 2
