import datetime as dt

import pytest
from annalist.functions import dates, text
from annalist.operators import entity, histories, repairs
from pyspark.sql import functions as F

D = dt.date


def rows(df, *order):
    return sorted(map(tuple, df.collect()), key=str)


def test_undone_and_swapped(spark):
    now = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7)], "id int, x string, n int")
    old = spark.createDataFrame([(1, "old", 0), (2, None, 0)], "id int, x string, n int")
    assert rows(repairs.undone(now, old, "id", ["x"], spark.createDataFrame([(2,)], "id int"))) == [(1, "a", 5), (2, None, 6), (3, "c", 7)]
    assert rows(repairs.swapped_numbers(now, spark.createDataFrame([(1, 3)], "a int, b int"), "id", "n")) == [(1, "a", 7), (2, "b", 6), (3, "c", 5)]


def test_cleaned_sides(spark):
    df = spark.createDataFrame([(1, "A & B wins", ["A", "B"], "A & B"), (2, "A & B", ["A", "B"], "A")], "id int, name string, people array<string>, cleaned string")
    assert rows(df.select("id", repairs.cleaned_side(F.col("name"), F.col("people"), F.col("cleaned")).alias("c"))) == [(1, "A & B"), (2, "A & B")]


def test_already_met(spark):
    old = spark.createDataFrame([(1, ["A", "B", "C"]), (1, ["D"])], "e int, p array<string>")
    new = spark.createDataFrame([(1, 7, ["B", "A"]), (1, 8, ["A", "D"]), (2, 9, ["A"])], "e int, id int, p array<string>")
    assert sorted(r.id for r in repairs.already_met(new, old, "e", "p", "id").collect()) == [8, 9]
    both = spark.createDataFrame([(["A", "T"], ["T"]), (["A"], ["B"])], "a array<string>, b array<string>")
    assert [r.o for r in both.select(repairs.any_overlap(F.col("a"), F.col("b")).alias("o")).collect()] == [True, False]


def test_moves_need_their_record(spark):
    df = spark.createDataFrame([(1, "a")], "id int, x string")
    with pytest.raises(Exception, match="no record"):
        repairs.moved_records(df, spark.createDataFrame([(2, "b")], "id int, x string"), "id", ["x"]).collect()


def test_plan_and_apply_agree(spark):
    df, p = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"), spark.createDataFrame([(1, "z"), (2, "b")], "id int, value string")
    after = repairs.plan_and_apply(df, p, "id", "x", dry_run=False)
    assert rows(after) == [(1, "z"), (2, "b")] and rows(repairs.plan_and_apply(df, p, "id", "x", dry_run=True)) == [(1, "a", "z")]
    assert repairs.plan_and_apply(after, p, "id", "x", dry_run=True).count() == 0


def test_content(spark):
    df = spark.createDataFrame([(1, " ", []), (2, "x", []), (3, None, ["y"])], "id int, a string, b array<string>")
    assert rows(repairs.with_content(df, "id", ["a", "b"])) == [(2, "x", None), (3, None, ["y"])]


def test_roster_aliases(spark):
    pages = spark.createDataFrame([("old-name", "New Name"), ("ann-lee", "Ann Lee"), ("bob", "Robert")], "slug string, name string")
    assert rows(entity.rename_pairs(pages)) == [("bob", "Robert"), ("old name", "New Name")]
    shipped = spark.createDataFrame([("a", "b"), ("c", "c"), ("x", "y")], "alias string, target string")
    assert rows(entity.recovered_aliases(shipped, spark.createDataFrame([("b", "z")], "alias string, target string"))) == [("a", "z"), ("x", "y")]
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "slug string")
    aliases = spark.createDataFrame([("old", "new"), ("gone", "nobody"), ("dup", "has")], "alias string, target string")
    assert rows(entity.rekeyed_assets(one("old", "gone", "dup", "has", "odd"), aliases, one("new", "has"))) == [("old", "new")]


def test_profiles(spark):
    names = spark.createDataFrame([("Ann Lee",), ("The Rock",), ("B. Jones",), ("Nick",), ("C. Twin",), ("Zed",)], "name string")
    profiles = spark.createDataFrame([("Ann Lee",), ("Rock",), ("Bob Jones",), ("Nicholas",), ("Carl Twin",), ("Chris Twin",)], "name string")
    aliases = spark.createDataFrame([("Nick", "Nicholas")], "alias string, target string")
    got = {r.name: (r.profile, r.rule) for r in entity.find_profile(names, profiles, aliases).collect()}
    assert got == {"Ann Lee": ("Ann Lee", "exact"), "The Rock": ("Rock", "the"), "B. Jones": ("Bob Jones", "initial"), "Nick": ("Nicholas", "alias"), "C. Twin": (None, None), "Zed": (None, None)}


def test_nights_of_two_records():
    ours = [(10, "WWF @ Albany, NY", ["Al Snow", "Steven Richards"]), (20, "Town", ["Bob"])]
    theirs = [(11, "Boston, MA", ["Al Snow", "Steven Richards"]), (11, "Albany, New York", ["Al Snow", "Steve Richards"]), (20, "x", ["Bobby"]), (20, "x", ["Bob"])]
    assert histories.night_matches(ours, theirs) == [(0, 1), (1, 3)]
    assert histories.town("Saint Louis, MO") == "st." and histories.town(None) == ""
    assert histories.same_person("D-Von Dudley", "Dvon") is False and histories.same_person("Jeff Hardy", "Jeff H")


def test_names_of_reigns():
    assert histories.names_of_reign("Wyatt Family: Erick Rowan & Luke Harper", ["Ann"]) >= {"wyattfamily", "erickrowan", "lukeharper", "ann"}
    assert histories.names_of_reign("A/B C") == {"bc"} and histories.names_of_reign("") == set()


def test_text_rules(spark):
    df = spark.createDataFrame([("Samckdown 5", "a<br>b <b>c</b><p></p>d", '<a href="?id=5&t=1">World <i>x</a> <a href="?id=5">Tag  Title</a>', "1. <b>Ann</b>\nx\n 2) Bob", "The Club (Al & Bo) vs. Cy (w/ Di)", "Nov 2001")], "t string, h string, l string, n string, g string, m string")
    r = df.select(text.show_name("t").alias("s"), text.line_texts("h").alias("h"), text.linked_stake("l", "id=5").alias("l"), text.numbered_rows("n").alias("n"), dates.month_start("m").alias("m"), text.as_json_text(F.array("t")).alias("j")).first()
    assert (r.s, r.h, r.l, [tuple(x) for x in r.n], r.m, r.j) == ("SmackDown", ["a", "b c", "d"], "Tag Title", [(1, "Ann"), (2, "Bob")], D(2001, 11, 1), '["Samckdown 5"]')
    assert [(x.label, x.members) for x in histories.members_by_date(df, "g", "m").collect()] == [("The Club", ["Al", "Bo"])]


def test_outgoing_champions(spark):
    df = spark.createDataFrame([(1, "lost by M. Hardy", ["Matt Hardy"]), (2, "lost by Edge", ["Matt Hardy"])], "id int, t string, n array<string>")
    assert rows(df.select("id", histories.outgoing(F.col("t"), F.col("n")).alias("o"))) == [(1, True), (2, False)]
    pages = spark.createDataFrame([(1, "Hardy won on 1/2/01. " + "x" * 100 + " 3/4/01")], "page int, text string")
    wanted = spark.createDataFrame([(1, "1/2/01", "Hardy"), (1, "3/4/01", "Hardy"), (1, "1/2/01", "Edge")], "page int, d string, s string")
    assert rows(histories.after_surname(pages, wanted, "page", "text", "d", "s")) == [(1, "1/2/01", "Hardy")]
    snaps = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "k string, n int, v string")
    assert rows(histories.latest_by(snaps, ["k"], [F.desc("n")])) == [("a", 2, "new")]
