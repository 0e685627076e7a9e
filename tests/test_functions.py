import datetime as dt

import pytest
from annalist.functions import dates, text
from pyspark.sql import functions as F


def one(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", build("v").alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def check(spark, cases, build):
    assert one(spark, [c[0] for c in cases], build) == [c[1] for c in cases]


def test_slugify(spark):
    check(spark, [("Big Ben", "big-ben"), ("Finn Bálor", "finn-blor"), ("  A -- b  ", "a-b"), ("???", "unknown"), (None, None)], text.slugify)


def test_normkey(spark):
    check(spark, [("The Rock", "rock"), ("Bálor", "balor"), ('"Stone" Cold', "cold"), ('"Nick"', "nick"), ("A.J. Styles", "ajstyles"), (None, None), ("??", "??"), ('Al "The Ax" Bo "Cy', "albocy"), ('"Dirty" Dominik', "dominik"), ('"???"', '"???"')], text.normkey)


@pytest.mark.parametrize("a, b, want", [("The Rock", "Rock", 3), ("MVP", "Montel Vontavious Porter", 3), ("John Smith", "John Smith-Jones", 2), ("Funaki", "Sho Funaki", 2), ("Al", "Al Snow", 0), ("K-Kwick", "K-Kwik", 1), ("Abe", "Zed", 0), ("J. Smith", "John Smith", 0), ("", "A", 0)])
def test_strength(a, b, want):
    assert text.strength(a, b) == want


def test_canonical_names(spark):
    check(spark, [("John Smith (c)", "John Smith"), ("and Bob Jones", "Bob Jones"), ("Bob Jones by pinfall", "Bob Jones"), ("Bob [note]", "Bob"), ("12", ""), (None, None), ("Al (with Ed)", "Al")], text.canonical_name)
    check(spark, [("2 jobbers", "2 local competitors"), ("a local athlete", "a local competitor"), ("Countout", None), ("The X", None), ("Jeff Hardy by TKO", "Jeff Hardy"), ("Layla ©", "Layla"), (": Jim)", "Jim"), ("Walter", "WALTER"), ("Jim", "Jim"), (" ", None)], text.clean_participant)
    check(spark, [("???", True), ("3 ninjas", True), ("El Local", False), ("El Local #1", True), ("Intercontinental Champion", True), ("Ann", False)], text.is_placeholder)


def test_prose(spark):
    check(spark, [("went to ring", True), ("Rick van Dam", False), ("Al Snow", False)], text.looks_like_prose)


def test_markup(spark):
    check(spark, [("<b>A</b> &amp; <i>B</i>", "A & B")], text.strip_tags)
    check(spark, [("x<ref>y</ref>z<ref name=a/>", "xz")], text.strip_refs)
    check(spark, [("a {{b|{{c}}}} d", "a  d"), ("{{a{{b{{c{{d{{e{{f}}}}}}}}}}}}x", "x"), ("}}{{", "}}{{"), (None, None)], text.strip_templates)
    check(spark, [("[[A (x)]] and [[B|C]]", "A and C")], text.unlink)
    check(spark, [("[[A (x)]] and [[B|C]]", ["A", "C"])], text.links)


def test_sides_and_stakes(spark):
    check(spark, [("A & B vs. C", [["A", "B"], ["C"]])], text.sides)
    check(spark, [("World Title / Tag Title", ["World Title", "Tag Title"]), ("#1 Contender Match", [])], text.belt_parts)
    check(spark, [('World Championship "Last Chance"', ("World Title", "Last Chance"))], lambda c: text.stake_label(c))
    check(spark, [("Undisputed World Championship", "belt::world"), ("WWF Intercontinental Title", "belt::intercontinental"), ("World Heavyweight Championship", "world::world heavyweight"), ("WWE World Tag Team Title", "belt::world tag team"), ("WWE Championship", "world::wwe")], text.belt_key)
    check(spark, [("WWE RAW Womens Championship Steel Cage Match", ["WWE Raw Women's Title"]), ("vacant", []), ("X Title Tournament - Final", ["X Title"]), ("X Title Tournament", []), ("A Title vs. B Championship", ["A Title", "B Title"])], text.belt_parts)
    check(spark, [("Triple Threat Match", 3), ("6-Way", 6), ("Singles", None)], text.declared_sides)
    check(spark, [("Steel Cage Ladder Match", "Steel Cage"), ("Singles", None)], text.stipulation)
    check(spark, [("X [Replacement for Y] & Z", {"X": "Y"})], text.stand_ins)
    check(spark, [("Arena in Town, State, Land", ("Arena", "Town", "State", "Land")), ("Town, Land", (None, "Town", None, "Land"))], text.location)


def test_outcomes(spark):
    rows = [(True, "pinfall", "win"), (False, "DQ", "loss_dq"), (True, "count out", "win_countout"), (None, "draw", "draw"), (None, None, "no_contest"), (False, "No Contest", "no_contest")]
    got = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, w boolean, f string").select("i", text.outcome("w", "f").alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == [r[2] for r in rows]


def test_dates(spark):
    d = dt.date
    check(spark, [("03.02.2001", d(2001, 2, 3)), ("31.02.2001", None), (None, None)], dates.day_first)
    check(spark, [("January 3, 2002", d(2002, 1, 3)), ("3 Janurary 2002", d(2002, 1, 3)), ("soon", None), ("February 30, 2002", None)], dates.long_date)
    check(spark, [("1/2/69", d(2069, 1, 2)), ("1/2/70", d(1970, 1, 2)), ("1/2/2001", d(2001, 1, 2))], dates.short_date)
    check(spark, [("April 2-3, 2022", [d(2022, 4, 2), d(2022, 4, 3)]), ("April 30-31, 2022", [d(2022, 4, 30)]), ("May 1, 2022", [d(2022, 5, 1)])], dates.nights)
    check(spark, [("2024-03-01", d(2024, 3, 1)), ("2024-03-02", d(2024, 3, 8))], lambda c: dates.on_or_after(c, "Fri"))


def test_air_days(spark):
    d = dt.date
    check(spark, [("2001-01-02", (d(2001, 1, 4), "air-night-estimate")), ("2005-09-07", (d(2005, 9, 9), "air-night-estimate")), ("2016-07-19", (d(2016, 7, 19), "live-broadcast")), ("2016-07-20", (d(2016, 7, 26), "air-night-estimate")), ("2019-10-04", (d(2019, 10, 4), "air-night-estimate"))], dates.air_day)


def test_numbers(spark):
    check(spark, [("(5:09)", 309), ("1:02:03", 3723), ("x", None)], dates.duration_seconds)
    check(spark, [("***1/2", 3.5), ("1/2*", 0.5), ("*1/2", 1.5), ("DUD", 0.0), ("-**", -2.0), ("x", None)], dates.stars)
    check(spark, [("12,345", 12345), ("none", None)], dates.digits)
    check(spark, [("2026", 2025), ("x", 0), (None, 0)], dates.era_start)
    check(spark, [("2001", "20010101"), ("20010203", "20010203")], lambda c: dates.bound(c, True))
    check(spark, [("01/2001 - 03/2002", ("2001-01", "2002-03")), ("05/2003", ("2003-05", "2003-05"))], dates.month_span)


def test_clean_cell(spark):
    assert one(spark, ["a\tb\nc"], text.clean_cell) == ["a b c"]
    assert one(spark, ["http://x/y/z.png?q=1"], text.base_name) == ["z"]
    assert spark.range(1).select(F.lit(1)).count() == 1
