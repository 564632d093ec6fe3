from pyspark.sql import functions as F

from lumenframe.functions import columns as c
from lumenframe.functions import paths, settings


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in TYPES.items() if k in values)).select(column).first()[0]


TYPES = {"a": "array<double>", "b": "array<double>", "s": "string", "t": "string"}


def test_hamming(spark):
    h = lambda s, t: one(spark, c.hamming(F.col("s"), F.col("t")), s=s, t=t)
    assert h("0" * 16, "0" * 16) == 0
    assert h("f" * 16, "0" * 16) == 64
    assert h("ffffffff00000000", "0" * 16) == 32
    assert h("ff", "0" * 16) == 64
    assert h(None, "0" * 16) == 64


def test_signature_distance(spark):
    d = lambda s, t: one(spark, c.signature_distance(F.col("s"), F.col("t")), s=s, t=t)
    assert d("f" * 16 + ":" + "0" * 16, "000000000000007f") == 7
    assert d(None, "0" * 16) == 64


def test_quantiles(spark):
    q = lambda f, a: one(spark, f(F.col("a")), a=a)
    assert q(c.upper_median, [4.0, 1.0, 3.0, 2.0]) == 3.0
    assert q(c.upper_median, []) is None
    assert q(c.upper_median, None) is None
    assert q(lambda a: c.nearest_rank(a, 0.85), [float(i) for i in range(10)]) == 8.0
    assert q(lambda a: c.nearest_rank(a, 0.3), [None, 5.0]) == 5.0
    assert q(lambda a: c.interpolated(a, 0.5), [1.0, 2.0, 3.0, 4.0]) == 2.5
    assert q(c.min_max, [2.0, 2.0]) == [0.5, 0.5]
    assert q(c.min_max, [0.0, 1.0, 2.0]) == [0.0, 0.5, 1.0]


def test_dot(spark):
    d = lambda a, b: one(spark, c.dot(F.col("a"), F.col("b")), a=a, b=b)
    assert d([1.0, 2.0], [3.0, 4.0]) == 11.0
    assert d([1.0], [3.0, 4.0]) == 0.0
    assert d(None, [1.0]) == 0.0


def test_name_time(spark):
    t = lambda s: one(spark, c.name_time(F.col("s")).cast("string"), s=s)
    assert t("IMG-20240131-WA0007.jpg") == "2024-01-31 00:00:07"
    assert t("vid-20240131-wa0034.mp4") == "2024-01-31 00:00:34"
    assert t("00003021-PHOTO-2026-04-08-08-43-11.jpg") == "2026-04-08 08:43:11"
    assert t("PHOTO-2026-99-99-08-43-11.jpg") is None and t("IMG-20269999-WA0001.jpg") is None
    assert t("VID_20240131_120501.mp4") is None and t("GX010001.MP4") is None and t(None) is None
    own = lambda s: one(spark, c.camera_name_time(F.col("s")).cast("string"), s=s)
    assert own("VID_20240131_120501.mp4") == "2024-01-31 12:05:01" and own("VID_20249999_120501.mp4") is None


def test_moments(spark):
    t = lambda s: one(spark, c.iso_time(F.col("s")), s=s)
    assert t("2025-05-13T17:14:33.000000Z") == t("2025-05-13T19:14:33+02:00") == t("2025:05:13 17:14:33") == 1747156473.0
    assert t("2025-05-13T17:14:33.5") == 1747156473.5 and t("2025-05-13") == 1747094400.0
    assert t("2025-13-13T17:14:33Z") is None and t("garbage") is None and t(None) is None and t("2025:99:13 17:14:33") is None


def test_levels_and_pixels(spark):
    assert one(spark, c.db_levels(F.col("s")), s="a RMS_level=-23.5 b RMS_level=-inf RMS_level=-60") == [-23.5, -60.0]
    assert one(spark, F.transform(c.db_levels(F.col("s")), c.db_to_unit), s="RMS_level=-6 RMS_level=-90 RMS_level=0") == [1.0, 0.0, 1.0]
    assert one(spark, F.transform(F.col("a"), lambda x: c.saturate(x)), a=[500.0, 0.0]) == [0.5, 0.0]
    rows = [[float(8 - k) for k in range(9)]] * 2 + [[float(k) for k in range(9)]] * 6
    flat = [x for r in rows for x in r]
    assert one(spark, c.difference_hash(F.col("a")), a=flat) == "ffff000000000000"
    assert one(spark, c.difference_hash(F.col("a")), a=flat[:71]) is None and one(spark, c.difference_hash(F.col("a")), a=[None, *flat[1:]]) is None


def test_padding(spark):
    assert one(spark, c.padded(F.col("a"), 3, F.lit(0.0)), a=[1.0]) == [1.0, 0.0, 0.0]
    assert one(spark, c.padded(F.col("a"), 1, F.lit(0.0)), a=[1.0, 2.0]) == [1.0]
    assert one(spark, c.extended(F.col("a"), 3), a=[1.0, 2.0]) == [1.0, 2.0, 2.0]
    assert one(spark, c.extended(F.col("a"), 2), a=None) == [0.0, 0.0]


def test_paths(spark):
    assert one(spark, c.stem(F.col("s")), s="/a/b.c/d.e.mp4") == "d.e"
    assert one(spark, c.extension(F.col("s")), s="/a/b.c/D.MP4") == ".mp4"
    assert one(spark, c.extension(F.col("s")), s="/a/.hidden") == ""


def test_path_spellings(spark):
    same = ["/m/Côte d/a b.MP4", "\\m\\côte d\\A B.mp4", " /m//côte d/./a b.mp4\n", "file:///m/c%C3%B4te%20d/a%20b.mp4", "/m/x/../côte d/a b.mp4", "/M/CÔTE D/A B.MP4"]
    assert len({paths.normal_path(p) for p in same}) == 1
    assert paths.normal_path(None) is None and paths.normal_path("") == ""
    assert paths.normal_path("/m/100%25.mp4") != paths.normal_path("/m/100%.mp4")
    odd = [*same, None, "", " ", "a", "/", "//", "./a", "a/.", "a/..", "..", "/a/../b", "/a/.b/c..d", "FILE:/x//y/", "file://x", "file:///a%2Fb", " \t/A B/\r\n", "/a/ ./b", "\x1f/a", "/A\u0130", "a\\", "/..a/b", "/a/b /", "x\ny"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(odd)], "i int, s string").select("i", paths.normalized(F.col("s")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: paths.normal_path(p) for i, p in enumerate(odd)}


def test_settings(spark):
    base = {"lut": None, "pace": "medium", "music_db": -8.0}
    assert settings.with_theme("chill", base, base) == {"lut": "chill", "pace": "slow", "music_db": -10.0}
    assert settings.with_theme("chill", base | {"pace": "fast"}, base)["pace"] == "fast"
    assert settings.with_theme("none", base, base) == base == settings.with_theme(None, base, base)
    assert settings.with_preview({"preview": False, "lut": "x"})["lut"] == "x"
    assert settings.with_preview({"preview": True, "aspect": "1:1", "lut": "x"}) == {"preview": True, "aspect": "1:1", "lut": None, "res": "480x480", "fps": 24, "no_reframe": True}
    size = lambda n: spark.range(1).select(settings.byte_size(F.lit(n))).first()[0]
    assert [size(512), size(1536), size(1024**2), size(5 * 1024**5)] == ["512 B", "1.50 KB", "1.00 MB", "5.00 PB"]
    assert one(spark, settings.slug(F.col("s")), s=" Hero 9 (black)! ") == "hero_9_black" and one(spark, settings.slug(F.col("s")), s="!!") == "camera"
