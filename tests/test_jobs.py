import datetime as dt

import pytest
from annalist.operators import gates, joins, rollup, timeline
from annalist.plans import api, jobs
from annalist.sources import schema

D = dt.date


def team(n, people, won, champion=False, outcome=None):
    return (n, "t", None, won, outcome, champion, people)


def match(order, *teams, stake=None, raw="", kind="Singles", result=None):
    return (order, kind, None, stake, 60, None, None, raw, list(teams), result)


def cards(spark):
    rows = [
        (1, D(2001, 1, 1), "RAW", "a", [match(1, team(1, ["Ann"], True, True), team(2, ["Bob"], False), stake="World Title"), match(2, team(1, ["Cat"], None), team(2, ["???"], None))]),
        (2, D(2001, 1, 8), "RAW", "b", [match(1, team(1, ["Bob"], True), team(2, ["Ann"], False, True), stake="World Championship")]),
        (3, D(2001, 1, 15), "RAW", "c", [match(1, team(1, ["Bob"], True, True), team(2, ["Ann"], False), stake="World Title")]),
    ]
    return spark.createDataFrame(rows, schema.CARD)


def test_rebuild(spark):
    t = jobs.rebuild(cards(spark))
    assert [(r.champion_names, r.pre_corpus, r.start) for r in t["reigns"].orderBy("idx").collect()] == [(["Ann"], True, D(2001, 1, 1)), (["Bob"], False, D(2001, 1, 8))]
    assert sorted((r.name, r.n, r.w, r.l, r.nc) for r in t["people"].collect()) == [("Ann", 3, 1, 2, 0), ("Bob", 3, 2, 1, 0), ("Cat", 1, 0, 0, 1)]
    assert [tuple(r) for r in t["wins"].collect()] == [("Bob", "belt::world", 1)]
    assert {(r.event_id, r.name) for r in t["holders"].collect()} == {(2, "Ann"), (3, "Bob")}
    assert t["search"].count() == 4 and t["names"].count() == 3


def test_steps_pass_over_what_moves_no_belt(spark):
    def night(i, kind="Singles", raw="", stake="World Title", result=None, show=None):
        return (show or i, D(2001, 1, i), "RAW", "x", [match(1, team(1, [f"P{i}"], True), team(2, ["Ann"], False, True), stake=stake, raw=raw, kind=kind, result=result)])

    rows = [night(1), night(2, kind="Tournament First Round"), night(3, kind="Best of Seven Series"), night(4, kind="Best Of Five Series", raw="TITLE CHANGE !!!"), night(5, show=221), night(6, stake="World Title #1 Contendership"), night(7, kind="World Title #1 Contendership Match"), night(8, stake='"If he loses"'), night(9, result=[("Tag Title", ["Q"], None), ("World Title", ["R"], [["S"]])])]
    got = {r.event_id: r for r in jobs.steps(spark.createDataFrame(rows, schema.CARD)).collect()}
    assert sorted(got) == [1, 4, 9] and got[4].marked and not got[1].marked
    assert got[9].ruling == ["R"] and got[9].within == [["S"]] and got[1].ruling is None


def test_rebuild_with_two_spellings(spark):
    def night(i, champion, other):
        return (i, D(2001, 1, i), "RAW", "x", [match(1, team(1, [champion], True, True), team(2, [other], False), stake="World Title")])

    t = jobs.rebuild(spark.createDataFrame([night(1, "Big Show", "Bob"), night(8, "The Big Show", "Al"), night(15, "Big Show", "Bob")], schema.CARD))
    assert [r.champion_names for r in t["reigns"].collect()] == [["Big Show"]]
    assert sorted((r.name, r.n) for r in t["people"].collect()) == [("Al", 1), ("Big Show", 3), ("Bob", 2)]
    assert {r.name for r in t["holders"].collect()} == {"Big Show"}


def test_api(spark):
    tables = {n: spark.createDataFrame([], c) for n, c in schema.TABLES.items()}
    tables["events"] = spark.createDataFrame([(1, D(2001, 12, 31), "RAW"), (2, D(2002, 1, 1), "RAW")], "event_id long, air_date date, show_type string")
    tables["matches"] = spark.createDataFrame([(7, 1, 1)], "match_id long, event_id long, match_order int")
    tables["match_teams"] = spark.createDataFrame([(3, 7, 1)], "team_id long, match_id long, team_number int")
    tables["match_participants"] = spark.createDataFrame([(3, 1, 9, "x"), (3, 2, None, "Bob (c)")], "team_id long, participant_order int, wrestler_id long, wrestler_name_used string")
    tables["wrestlers"] = spark.createDataFrame([(9, "Ann")], "wrestler_id long, canonical_name string")
    assert [(r.event_id, r.match_count) for r in api.month(tables["events"], tables["matches"], 2001, 12).collect()] == [(1, 1)]
    assert api.event(tables, 1).first().matches[0].teams[0].participants == ["Ann", "Bob"]
    assert api.event(tables, 99).count() == 0
    assert tuple(api.health(tables["events"], tables["matches"], tables["wrestlers"]).first()) == (2, 1, 1)
    with pytest.raises(ValueError):
        api.month(tables["events"], tables["matches"], 2001, 13)
    schema.check({"matches": tables["matches"].selectExpr("*", "'high' AS parse_confidence")})
    with pytest.raises(gates.GateError):
        schema.check({"matches": tables["matches"].selectExpr("*", "'odd' AS parse_confidence")})


def test_spans_and_families(spark):
    e = spark.createDataFrame([(1, D(2001, 2, 5), "f"), (2, D(2003, 1, 1), "f")], "event_id int, air_date date, family string")
    s = spark.createDataFrame([("x", "2001-01", "2001-02")], "span string, start string, end string")
    assert [tuple(r) for r in joins.covering(e, s, "event_id", "span").collect()] == [(1, "x")]
    r = spark.createDataFrame([("f", 2, None, None, "late"), ("f", 1, D(2001, 1, 1), D(2001, 12, 31), "early")], "family string, priority int, lo date, hi date, logo string")
    assert [tuple(x) for x in joins.first_family(e, r, "event_id", "air_date", "logo").orderBy("event_id").collect()] == [(1, "early"), (2, "late")]


def test_records(spark):
    r = spark.createDataFrame([("l", "p", 1, ["A"], D(2001, 1, 1)), ("l", "q", 1, ["A"], D(2001, 1, 1)), ("l", "q", 2, ["B"], D(2002, 1, 1))], "lineage string, page string, seq int, champion_names array<string>, start date")
    assert [(x.champion_names, x.place) for x in timeline.merged_reigns(r).orderBy("place").collect()] == [(["B"], 1), (["A"], 2)]
    p = spark.createDataFrame([(D(2001, 1, 9), D(2001, 1, 1), None), (D(2001, 1, 9), D(2001, 1, 1), D(2001, 1, 9)), (D(2001, 1, 2), D(2001, 1, 1), None)], "ours date, theirs date, aired date")
    assert timeline.off_dates(p).count() == 1
    n = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (2, 1, "C")], "day int, match_order int, winner string")
    assert sorted(map(tuple, timeline.same_night(n, n.where("winner <> 'B'")).collect())) == [(1, False), (2, True)]
    m = spark.createDataFrame([(1, 1, 2001), (1, 2, 2001)], "event_id int, match_order int, year int")
    v = spark.createDataFrame([(1, None), (1, 2)], "event_id int, match_order int")
    assert tuple(rollup.coverage(m, v).first()) == (2001, 1, 1, 2, 1)
