import json
import uuid

import pytest

from hillstream.operators import folds, states, threads
from hillstream.plans import queries, sinks
from hillstream.sources import tables
from hillstream.streaming import keyed
from tests.test_resolve_and_threads import EVENTS, THREAD


def stream(spark, tmp_path, df, f, mode="append"):
    path, name = str(tmp_path / uuid.uuid4().hex), "t" + uuid.uuid4().hex
    df.coalesce(1).write.parquet(path)
    q = f(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_throttle(spark, tmp_path):
    df = spark.createDataFrame([(k, x / 8) for x in range(40) for k in (0, 1)], "m int, t double")
    assert rows(stream(spark, tmp_path, df, lambda s: keyed.throttled_stream(s, ["m"], "t", 2))) == rows(folds.throttled(df, ["m"], "t", ["t"], 2))


def test_debounce(spark, tmp_path):
    df = spark.createDataFrame([(0, float(i), v) for i, v in enumerate([1, 1, 0, 0, None, 1, 1, 0, 0, 1, 1, 0, 1])], "m int, t double, v long")
    got = stream(spark, tmp_path, df, lambda s: keyed.debounced_stream(s, ["m"], "t", "v"))
    assert rows(got.select("m", "t", "accepted", "uses")) == rows(states.cycle_counts(df, "v", ["m"], ["t"]).select("m", "t", "accepted", "uses"))


def test_threads(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, THREAD)
    assert rows(stream(spark, tmp_path, df, lambda s: keyed.event_threads_stream(s, ["m"], ["t"]))) == rows(threads.event_threads(df, ["m"], ["t"]))


def test_late_rows_are_waited_for_and_taken_in_order(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=s)
    src, name = tmp_path / "in", "t" + uuid.uuid4().hex
    schema = "m int, t double, v long, ts timestamp"
    # arrival: 1 and 3 before 2; the next file moves the watermark on; then one too late, and one that ends it
    files = [[(0, 1.0, 1), (0, 3.0, 0)], [(0, 2.0, 1), (1, 1.0, 1)], [(0, 60.0, 0), (1, 61.0, 1)], [(0, 4.0, 1), (0, 62.0, 0)], [(2, 10000.0, 1)], [(2, 20000.0, 1)]]
    df = None
    for i, rows_ in enumerate(files):
        (spark.createDataFrame([(m, t, v, at(t)) for m, t, v in rows_], schema).coalesce(1).write.mode("append").parquet(str(src)) if i == 0 else None)
        if i == 0:
            stream_ = keyed.debounced_stream(spark.readStream.schema(schema).parquet(str(src)), ["m"], "t", "v", event_time="ts", late="10 seconds", keep=60.0)
            df = stream_.writeStream.format("memory").queryName(name).outputMode("append").start()
        else:
            spark.createDataFrame([(m, t, v, at(t)) for m, t, v in rows_], schema).coalesce(1).write.mode("append").parquet(str(src))
        df.processAllAvailable()
    df.stop()
    got = sorted((r.m, r.t, r.accepted, r.uses) for r in spark.table(name).collect())
    want = [(0, 1.0, None, 0), (0, 2.0, 1, 0), (0, 3.0, 1, 0), (0, 60.0, 0, 0), (0, 62.0, 0, 0), (1, 1.0, None, 0), (1, 61.0, 1, 0), (2, 10000.0, None, 0)]
    assert got == sorted(want)


def test_latest_and_windows(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, "a"), (0, 3, "c"), (0, 2, "b"), (1, 1, "d")], "m int, t int, v string")
    assert rows(stream(spark, tmp_path, df, lambda s: keyed.latest_state(s, ["m"], ["t"], ["t", "v"]), "complete")) == [(0, 3, "c"), (1, 1, "d")]
    import datetime as dt

    at = [dt.datetime(2024, 1, 1, 0, m) for m in (0, 1, 7, 59)]
    df = spark.createDataFrame([(0, t) for t in at], "m int, ts timestamp")
    got = stream(spark, tmp_path, df, lambda s: keyed.windowed_counts(s, "ts", ["m"]))
    assert [(r.m, r.n) for r in got.orderBy("start").collect()] == [(0, 2), (0, 1)]


def test_live_json(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, "a"), (0, 3, "c")], "m int, t int, v string")
    df.write.parquet(str(tmp_path / "in"))
    q = keyed.live_json(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), ["m"], ["t"], ["t", "v"], str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("m", "t", "v").collect()] == [(0, 3, "c")]


def test_csv_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(0, 10, 1, None, 2, 0, 0, 0), (0, 20, 3, 4, None, 1, 1, 0)], "m int, timestamp int, " + tables.TELEMETRY.split(", ", 1)[1])
    k = spark.createDataFrame([(0, 10, 1, 5), (0, 20, 2, 7)], "m int, timestamp int, player_id int, n int")
    t = sinks.telemetry_table(s, k, ["m"], [(1, "Jo"), (2, "Jo")])
    assert t.columns[-2:] == ["Jo", "Jo_2"]
    sinks.write_csv(t.drop("m").coalesce(1), str(tmp_path / "t"))
    back = tables.telemetry_csv(spark, str(tmp_path / "t"), ["Jo", "Jo_2"])
    assert rows(back) == rows(t.drop("m"))
    sinks.write_csv(t, str(tmp_path / "p"), ["m"])
    assert (tmp_path / "p/m=0").exists()


def test_documents_and_report(spark):
    d = queries.QUERIES["summary_documents"](spark, "/root/testdata/sf0.001").orderBy("match_id").first().document
    doc = json.loads(d)
    assert doc["final_score"] == {"blue": 250} and len(doc["registry"]) == 8 and sum(doc["kills"].values()) == sum(doc["deaths"].values())
    none = sinks.report_lines(spark.createDataFrame([(0, 1, "a", "ally", 2, 1)], "m int, player_id int, name string, team string, kills long, deaths long"), ["m"])
    assert [tuple(r) for r in none.orderBy("team").collect()] == [(0, "ally", 1, "- a: 2 kills, 1 deaths"), (0, "enemy", 1, "- none")]


def test_images_and_frames(spark, tmp_path):
    for name in ("3/a.png", "3/b.txt", "4/c.jpeg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.label for r in tables.image_files(spark, str(tmp_path)).collect()) == ["3", "4"]
    (tmp_path / "4/d.png").write_bytes(b"unreadable")
    assert tables.templates(spark, str(tmp_path), lambda raw: raw if raw == b"x" else None) == {"3": [b"x"], "4": [b"x"]}
    with pytest.raises(ValueError):
        tables.templates(spark, str(tmp_path), bytes, most=2)
    f = spark.createDataFrame([(0, 1.0, 1), (0, 2.5, 2), (0, 3.0, 3)], "m int, t double, i int")
    assert [r.i for r in tables.frame_at(f, ["m"], "t", 2).collect()] == [2]
    from hillstream.functions.image import read_images

    got = read_images(spark.createDataFrame([(1, bytearray(b"ab")), (2, None)], "i int, image binary"), lambda: lambda b: {"n": len(b)}, "n double").collect()
    assert [(r.i, r.n) for r in got][0] == (1, 2.0)


def test_recorded_frames(spark, tmp_path):
    from hillstream.sources.frames import kept_frame, recorded_frames

    (tmp_path / "my match.bin").write_bytes(bytes(range(40)))
    got = recorded_frames(spark, str(tmp_path), lambda raw: ((i, bytes([b])) for i, b in enumerate(raw)), 30, 4, 0.5).orderBy("frame_index").collect()
    assert [(r.match_id, r.frame_index, r.timestamp_seconds, bytes(r.image)) for r in got] == [("my_match", i, i / 30, bytes([i])) for i in (16, 24, 32)]
    by_path = recorded_frames(spark, str(tmp_path), lambda path: ((i, bytes([b])) for i, b in enumerate(open(path.removeprefix("file:").replace("%20", " "), "rb").read())), lambda path: 30.0, 4, 0.5, by_path=True).orderBy("frame_index")  # noqa: SIM115
    assert [(r.frame_index, bytes(r.image)) for r in by_path.collect()] == [(i, bytes([i])) for i in (16, 24, 32)]
    assert kept_frame(0, 0, 100, 0) and not kept_frame(29, 29.97, 1, 1)
