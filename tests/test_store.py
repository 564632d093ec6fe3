"""Documents, sidecars, caches, streams of progress and extraction, with nulls, repeats, broken inputs and empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import extract
from lumenframe.sources import store
from lumenframe.streaming import progress


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"plan_id": "a", "entries": [{"source": "s", "start_s": 1, "end_s": 3, "junk": 1}], "more": {}}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    got = {r.plan_id: r.entries for r in store.read_documents(spark, str(tmp_path), f"plan_id string, entries array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in ('source string', 'start_s double', 'end_s double'))}>>").collect()}
    assert got["a"][0].end_s == 3.0 and got[None] is None and len(got) == 2


def test_lenient_entries(spark):
    texts = ['{"source": "s", "start_s": 1, "end_s": 3.5}', '{"source": "s", "start_s": 1, "end_s": 3, "speed": 0.5, "reasons": ["x"], "components": {"a": 1}, "new": 1}', '{"source": "s"}', "[]", "{", None, ""]
    got = [r.e for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", store.plan_entry(F.col("t")).alias("e")).orderBy("i").collect()]
    assert (got[0].out_duration_s, got[0].speed, got[0].score, got[0].reasons, got[0].components) == (2.5, 1.0, 0.0, [], {})
    assert (got[1].speed, got[1].reasons, got[1].components) == (0.5, ["x"], {"a": 1.0})
    assert got[2:] == [None] * 5


def test_sidecars(spark):
    texts = ['{"banned": ["b", 1, "a", "b", null, {"x": 1}]}', '{"banned": "no list"}', "{broken", "[1]", None, "{}"]
    got = [r.b for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", store.sidecar_list(F.col("t"), "banned").alias("b")).orderBy("i").collect()]
    assert got == [["b", "a"], [], [], [], [], []]
    row = spark.createDataFrame([(["x", None, "y", "x"], None)], "a array<string>, b array<string>").select(store.sidecar_json(banned=F.col("a"), favorited=F.col("b")).alias("t")).first()
    assert json.loads(row.t) == {"banned": ["x", "y"], "favorited": []}


def test_latest_and_requests(spark):
    r = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("a", 3.0, 3), ("b", None, 4), ("b", 0.5, 5), ("c", None, 6), (None, 9.0, 7)], "k string, at double, id int")
    assert sorted(x.id for x in store.latest(r, "k", "at", "id").collect()) == [3, 5, 6]
    assert store.latest(r.where("false"), "k", "at", "id").count() == 0
    asked = spark.createDataFrame([("z", 0), ("b", 1), ("a", 2), ("b", 3)], "name string, place int")
    known = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, v int")
    assert [(x.name, x.place) for x in store.in_request_order(asked, known, "name", "place").orderBy("place").collect()] == [("b", 0), ("a", 1)]
    with pytest.raises(IndexError):
        store.nth(known, "v", 9)
    with pytest.raises(IndexError):
        store.nth(known.where("false"), "v", 0)


def test_caches(spark):
    cache = spark.createDataFrame([("a", 1.0, 5, 0), ("b", 2.0, 5, 1)], "key string, at double, size int, hits int")
    new = spark.createDataFrame([("a", 3.0, 4), ("c", 4.0, 50)], "key string, at double, size int")
    assert {r.key for r in store.cache_put(cache, new, "key", "at", "size", 20).collect()} == {"c"}  # the newest stays, however large
    assert {(r.key, r["size"]) for r in store.cache_put(cache, new, "key", "at", "size", 55).collect()} == {("c", 50), ("a", 4)}
    assert {r.key for r in store.cache_put(cache, new.where("false"), "key", "at", "size", 0).collect()} == {"a", "b"}
    asked = spark.createDataFrame([("a", 7.0), ("a", 8.0), ("x", 9.0)], "key string, at double")
    used, stats = store.cache_get(cache, asked, "key", "at")
    assert {(r.key, r.at, r.hits) for r in used.collect()} == {("a", 8.0, 2), ("b", 2.0, 1)} and tuple(stats.first()) == (2, 1)


def test_capture_times(spark):
    rows = [("/a/x.jpg", "2025:05:13 17:14:33", "2024-01-01T00:00:00Z"), ("/a/x.mov", "2025:05:13 17:14:33", "2024-01-01T00:00:00Z"), ("/a/IMG-20240131-WA0007.jpg", "bad", None), ("/a/y.png", None, "2024-01-01T00:00:00Z"), ("/a/z.mp4", None, None)]
    got = [r.t for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, e string, c string").select("i", store.captured_at(F.col("p"), F.col("e"), F.col("c"), F.lit(5.0)).alias("t")).orderBy("i").collect()]
    assert got == [1747156473.0, 1704067200.0, 1706659207.0, 1704067200.0, 5.0]


def test_typed_progress(spark):
    lines = ["frame=12.7", "fps=x", "speed=0.998x", "out_time=00:01", "bitrate=N/A", "progress=continue", "speed=N/A", "frame=3"]
    b = progress.progress_blocks(spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "job int, seq int, line string"), "job", "seq", "line")
    got = progress.typed_fields(b).orderBy("block").collect()
    assert got[0].integers == {"frame": 12, "fps": None, "bitrate": None} and got[0].numbers == {"speed": 0.998} and got[0].texts == {"out_time": "00:01", "progress": "continue"}
    assert got[1].integers == {"frame": 3} and got[1].numbers == {"speed": None}


def test_progress_block_stream(spark, tmp_path):
    """Blocks that are cut by the borders of micro-batches come out whole."""
    (tmp_path / "in").mkdir()
    parts = [["frame=1", "speed=1x"], ["progress=continue", "frame=2"], ["progress=end", "junk"]]
    for i, part in enumerate(parts):
        spark.createDataFrame([("j", 10 * i + k, t) for k, t in enumerate(part)], "job string, seq int, line string").coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        next((tmp_path / f"p{i}").glob("*.parquet")).rename(tmp_path / "in" / f"{i}.parquet")
    stream = spark.readStream.schema("job string, seq int, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = progress.progress_block_stream(stream, "job", "seq", "line").writeStream.outputMode("append").format("memory").queryName("blocks_out").start()
    q.processAllAvailable()
    q.stop()
    assert [r.fields for r in spark.table("blocks_out").collect()] == [{"frame": "1", "speed": "1x", "progress": "continue"}, {"frame": "2", "progress": "end"}]


def test_logs(spark):
    lines = ["a: 5 item(s) in range", "x copied=1 skipped=2 failed=0", "noise", "y copied=3 skipped=0 failed=1"]
    df = spark.createDataFrame([("j", i, t) for i, t in enumerate(lines)] + [("k", 0, None)], "job string, seq int, line string")
    got = {(r.job, r.seq): (r.copied, r.skipped, r.failed, r.total) for r in store.log_counters(df, "job", "seq", "line").collect()}
    assert got["j", 3] == (4, 2, 1, 5) and got["j", 0] == (0, 0, 0, 5) and got["k", 0] == (0, 0, 0, 0)
    assert {r.job: r.tail for r in store.log_tails(df, "job", "seq", "line", 2).collect()}["j"] == lines[2:]


def test_extraction(spark):
    def fn(row):
        if row["x"] == 3:
            raise ValueError("three")
        return None if row["x"] == 4 else {"y": row["x"] * 2.0}

    got = {r.x: (r.y, r.error) for r in extract.extract(spark.range(6).select(F.col("id").alias("x")).repartition(3), fn, "y double, z string", ["x"]).collect()}
    assert got == {0: (0.0, None), 1: (2.0, None), 2: (4.0, None), 3: (None, "ValueError: three"), 4: (None, None), 5: (10.0, None)}
    assert extract.extract(spark.range(0).withColumnRenamed("id", "x"), fn, "y double", ["x"]).count() == 0


def test_models_and_optional_modules(spark):
    twice = extract.model_udf(lambda: 2, lambda model, s: s * model, "bigint")
    assert [r[0] for r in spark.range(3).select(twice("id")).collect()] == [0, 2, 4]
    told = []
    missing = extract.Dependency("no_such_module_here", told.append)
    df = extract.gated(extract.gated(spark.range(1), missing, "a", lambda m: F.lit(1.0), "double"), missing, "b", lambda m: F.lit(1.0), "double")
    assert tuple(df.first()) == (0, None, False, None, False) and len(told) == 1 and not missing
    assert tuple(extract.gated(spark.range(1), extract.Dependency("math"), "pi", lambda m: F.lit(m.pi), "double").first())[1:] == (pytest.approx(3.14159, abs=1e-4), True)


def test_engine(spark, tmp_path):
    from lumenframe.engine import Engine

    e = Engine(spark, str(tmp_path / "store"))
    clips = spark.createDataFrame([(0, "/a.mp4", 3.0), (1, "/b.mp4", 4.0)], "pos int, source string, duration_s double")
    c = e.analyze(clips, ["source", "duration_s"])
    assert e.analyze(clips.orderBy("pos", ascending=False), ["source", "duration_s"]) == c and e.catalog(c).count() == 2
    assert e.analyze(clips.where("pos = 0"), ["source", "duration_s"]) != c
    assert e.inspect_clip(c, "pos", 1).first().source == "/b.mp4"
    with pytest.raises(IndexError):
        e.inspect_clip(c, "pos", 2)
    with pytest.raises(KeyError):
        e.plan("nothing") if (tmp_path / "store" / "plans").exists() else e.catalog("nothing")
    entries = spark.createDataFrame([(i, s, float(i), i + 1.0, 1.0, 9.0 - i) for i, s in enumerate(["/a.mp4", "/b.mp4", "/a.mp4"])], "pos int, source string, start_s double, end_s double, out_duration_s double, score double")
    p = e.propose(c, entries, 1.0, pace="slow")
    q = e.tweak(p, [("exclude_source", {"source": "/b.mp4"}), ("set", {"pos": 1, "field": "score", "value": 1.5})], 2.0)
    assert p != q and e.plan(p).count() == 3 and [r.score for r in e.plan(q).orderBy("pos").collect()] == [9.0, 1.5]
    assert tuple(e.summary(q).first())[1:] == (2, 1, 2.0) and e.latest(c).first().plan_id == q and e.header(p).first().catalog_id == c
    with pytest.raises(ValueError):
        e.tweak(p, [("nothing", {})])
    (tmp_path / "film.cube").write_text("x")
    assert [r.name for r in e.colour_tables(str(tmp_path / "film.cube")).collect()] == ["film"] and len(e.themes()) == 4 and e.options().count() == 21
