import pytest
from pyspark.sql import functions as F

from hillstream.functions import geometry, scores, text
from hillstream.sources import settings


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_times(spark):
    s = values(spark, [(None,), ("192",), ("3:12",), ("-5",), (" ",)], "x string", text.seconds_of(F.col("x")))
    assert [r[0] for r in s] == [0.0, 192.0, 192.0, 0.0, 0.0]
    with pytest.raises(Exception, match="not a time"):
        values(spark, [("1:2:3",)], "x string", text.seconds_of(F.col("x")))
    assert values(spark, [("14:12",), ("852",)], "x string", text.time_label(F.col("x"))) == [("14m12s",), ("852s",)]
    assert values(spark, [("3:12",), ("-4",)], "x string", text.preview_seconds_of(F.col("x"))) == [(192.0,), (-4.0,)]
    with pytest.raises(Exception, match="needed"):
        values(spark, [("",)], "x string", text.preview_seconds_of(F.col("x")))
    assert [settings.seconds(x) for x in (None, "", "3:12", 5, "-1")] == [0, 0, 192, 5, 0]


def test_names(spark):
    rows = [("[TAG]Player",), ("[ABC]",), ("A  [x] B",), ("Åse_é-1",)]
    got = values(spark, rows, "x string", text.player_name(F.col("x")), text.ocr_text(F.col("x")), text.match_key(F.col("x")), text.ascii_key(F.col("x")), text.display_name(F.col("x")))
    assert [r[0] for r in got] == ["Player", "ABC", "A B", "Åse_é-1"]
    assert got[3][1:] == ("Åse_é-1", "åseé1", "se1", "se_-1")
    assert text.header_names(["Jo", "Jo", "Jo", "Jo_2"]) == ["Jo", "Jo_2", "Jo_3", "Jo_2_2"]
    assert values(spark, [("a1b2",), ("x",)], "x string", text.digits_only(F.col("x"))) == [("12",), (None,)]
    assert values(spark, [("3.9",), (" ",), (None,), ("-2.7",)], "x string", text.whole_number(F.col("x"))) == [(3,), (None,), (None,), (-2,)]
    assert values(spark, [("/a/My Match.v1.mp4",)], "x string", text.path_stem(F.col("x"))) == [("My_Match.v1",)]
    assert values(spark, [(" KF ",), ("zz",)], "x string", text.alias_lookup(F.col("x"), {"kf": "killfeed"})) == [("killfeed",), (None,)]


def test_similarity(spark):
    rows = [("abcd", "abce"), ("abc", "abcd"), ("", "a"), ("same", "same")]
    got = values(spark, rows, "a string, b string", text.dice(F.col("a"), F.col("b"), 2), text.roster_similarity(F.col("a"), F.col("b")), text.longest_common_part(F.col("a"), F.col("b")), text.feed_similarity(F.col("a"), F.col("b")))
    assert got[0][0] == pytest.approx(4 / 6) and [r[1] for r in got] == [0.75, 0.75, 0.0, 1.0]
    assert got[0][2] == 0.75 and got[3][3] == 1.0 and got[2][3] == 0.0
    assert got[0][3] == pytest.approx(0.17 * 0.75 + 0.22 * 4 / 6 + 0.24 * 0.5 + 0.12 * 0.75 + 0.15)


def test_scores(spark):
    assert values(spark, [(3, 0), (7, 3), (1, 8)], "k int, d int", scores.kill_ratio(F.col("k"), F.col("d"))) == [(3.0,), (2.33,), (0.13,)]
    assert [r[0] for r in values(spark, [(0.05,), (0.2,), (0.5,), (0.75,), (1.0,)], "v double", scores.band_score(F.col("v"), 0.1, 0.5))] == pytest.approx([0.5, 1, 1, 0.5, 0])
    c = [F.col(x) for x in "abc"]
    assert values(spark, [(0.0, None, 0.4), (None, 0.0, 0.0), (0.3, 0.5, -1.0)], "a double, b double, c double", scores.first_truthy(*c), scores.mean_positive(*c)) == [(0.4, 0.4), (0.0, None), (0.3, 0.4)]
    assert values(spark, [("250",), ("251",), ("007",), ("9",), ("300",), ("25",)], "x string", scores.digit_domain(F.col("x"))) == [(True,), (False,), (False,), (True,), (False,), (True,)]
    assert values(spark, [("1.5",), ("x",)], "x string", scores.as_number(F.col("x"))) == [(1.5,), (None,)]
    assert values(spark, [(1,)], "x int", scores.whole_kills(F.create_map(F.col("x"), F.lit(2.0)))) == [({"1": 2},)]


def test_boxes(spark):
    box = "struct<x:int,y:int,w:int,h:int>"
    rows = [((0, 0, 10, 10), (5, 0, 10, 10)), ((0, 0, 10, 10), (41, 0, 10, 10))]
    got = values(spark, rows, f"a {box}, b {box}", geometry.overlap(F.col("a"), F.col("b")), geometry.alike(F.col("a"), F.col("b")))
    assert got[0] == (pytest.approx(1 / 3), True) and got[1] == (0.0, False)
    quad = spark.createDataFrame([([(1.9, 2.2), (11.7, 2.0), (11.0, 9.9), (1.5, 9.0)],)], "q array<struct<x:double,y:double>>")
    assert tuple(quad.select(geometry.box_of(F.col("q")).alias("b")).first().b) == (1, 2, 10, 7)
    region = spark.createDataFrame([((0.1, 0.2, 0.5, 0.25),), (None,)], "r struct<x:double,y:double,w:double,h:double>")
    got = [r.p and tuple(r.p) for r in region.select(geometry.pixels(F.col("r"), F.lit(101), F.lit(50)).alias("p")).collect()]
    assert got == [(10, 10, 50, 12), None]


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("capture: {start_time: '1:05', start_time_seconds: 3}\nscoreboard: {header_template_path: a/h.png}\n")
    data = settings.load(tmp_path / "c.yaml")
    assert settings.section(data, "capture")["start_time_seconds"] == 65.0
    assert data["scoreboard"]["header_template_path"] == str(tmp_path / "a/h.png") and settings.section(data, "none") == {}
