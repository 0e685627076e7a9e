import datetime as dt

import pytest
from annalist.operators import cards, entity, gates, joins, reconcile, rollup
from pyspark.sql import functions as F

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_validity_join_has_open_bounds(spark):
    eras = spark.createDataFrame([("a", None, D(2000, 1, 1)), ("b", D(2000, 1, 1), None)], "name string, lo date, hi date")
    days = spark.createDataFrame([(1, D(1999, 1, 1)), (2, D(2000, 1, 1))], "id int, d date")
    assert rows(joins.validity_join(days, eras, F.col("d")).select("id", "name"), "id", "name") == [(1, "a"), (2, "a"), (2, "b")]


def test_nearest_and_limits(spark):
    a = spark.createDataFrame([(1, D(2000, 1, 10)), (2, D(2001, 1, 1))], "id int, day date").withColumn("k", F.lit(1))
    b = spark.createDataFrame([("x", D(2000, 1, 8)), ("y", D(2000, 1, 12))], "v string, e date").withColumn("k", F.lit(1))
    assert rows(joins.nearest(a, b, ["k"], "day", "e", "v", "id"), "id") == [(1, "x", 2), (2, "y", 355)]
    assert rows(joins.nearest(a, b, ["k"], "day", "e", "v", "id", 10), "id") == [(1, "x", 2), (2, None, None)]
    assert rows(joins.as_of(a, b, ["k"], "day", "e", "v", "id"), "id") == [(1, "x"), (2, "y")]
    assert rows(joins.offset_probe(a, b, ["k"], "day", "e", "v", "id"), "id") == [(1, "y", 2)]


def test_stab_join_ends_are_inclusive(spark):
    iv = spark.createDataFrame([("A", D(2000, 1, 1), D(2000, 2, 1)), ("B", D(2000, 2, 1), None)], "h string, start date, end date").withColumn("k", F.lit(1))
    day = spark.createDataFrame([(1, D(2000, 1, 1)), (2, D(2000, 2, 1)), (3, D(2000, 3, 1))], "id int, day date").withColumn("k", F.lit(1))
    assert rows(joins.stab_join(day, iv, ["k"], "day").select("id", "h"), "id", "h") == [(2, "A"), (3, "B")]


def test_tiers_claim_once(spark):
    left = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, None, "b")], "id int, nr int, d string")
    right = spark.createDataFrame([(7, 10, "a"), (8, 99, "b"), (9, 98, "b")], "rid int, rnr int, rd string")
    got = joins.tiered(left, right, "id", "rid", [("nr", [F.col("nr")], [F.col("rnr")]), ("day", [F.col("d")], [F.col("rd")])])
    assert rows(got, "id") == [(1, 7, "day")]  # two rows claim number 10, and two are on day b
    got = joins.tiered(left, right.where("rid < 9"), "id", "rid", [("nr and day", [F.col("nr"), F.col("d")], [F.col("rnr"), F.col("rd")]), ("nr", [F.col("nr")], [F.col("rnr")]), ("day", [F.col("d")], [F.col("rd")])])
    assert rows(got, "id") == [(1, 7, "nr and day")]
    e = spark.createDataFrame([(1, D(2001, 1, 1)), (2, D(2001, 3, 1))], "id int, a date").withColumn("k", F.lit(1))
    f = spark.createDataFrame([(5, D(2001, 1, 9)), (6, D(2001, 2, 25)), (7, D(2001, 3, 5))], "rid int, b date").withColumn("k", F.lit(1))
    assert rows(joins.tiered(e, f, "id", "rid", [("ten days", [F.col("k")], [F.col("k")], (F.col("a"), F.col("b"), 10))]), "id") == [(1, 5, "ten days")]


def test_overlap_rejects_ties(spark):
    a = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"])], "id int, s array<string>").withColumn("k", F.lit(1))
    b = spark.createDataFrame([(5, ["x", "y"]), (6, ["x", "z"]), (7, ["z"])], "rid int, t array<string>").withColumn("k", F.lit(1))
    assert rows(joins.best_overlap(a, b, ["k"], "id", "rid", "s", "t"), "id") == [(1, 5, 2)]


def test_keys_of_sides(spark):
    df = spark.createDataFrame([(1, [["b", "a"], ["c"]]), (2, [["c"], ["a", "b"]])], "id int, s array<array<string>>")
    assert df.select(joins.sides_key(F.col("s")).alias("k")).distinct().count() == 1


def test_aliases_take_two_hops(spark):
    al = spark.createDataFrame([("a", "b"), ("b", "c")], "alias string, target string")
    names = spark.createDataFrame([("a",), ("b",), ("z",)], "name string")
    assert rows(joins.two_hops(names, "name", al).select("name", "canonical"), "name") == [("a", "c"), ("b", "c"), ("z", "z")]


def test_token_subset_of_many_copies_and_odd_rows(spark):
    """As the plain join of all pairs of a key; copies of a name are not joined one by one."""
    import itertools
    import random

    def plain(left, right):
        fits = lambda s, t: s is not None and t is not None and set(s) & set(t) and (set(s) <= set(t) or set(t) <= set(s))
        pairs = {(i, j) for (i, k, s), (j, m, t) in itertools.product(left, right) if k is not None and k == m and fits(s, t)}
        return {(i, j) for i, j in pairs if sum(p[0] == i for p in pairs) == 1}

    rng = random.Random(3)
    draw = lambda n, first: [(rng.choice([first + i, first + i // 2, None] if i % 5 == 0 else [first + i]), rng.choice([1, 1, 2, None]), rng.choice([None, []]) if i % 11 == 0 else [rng.choice(["a", "b", "c", "", None, *(f"w{x}" for x in range(30))]) for _ in range(rng.randint(1, 3))]) for i in range(n)]
    left, right = draw(90, 0), draw(60, 1000)
    frame = lambda rows_, id_, s: spark.createDataFrame(rows_, f"{id_} long, y long, {s} array<string>")
    want = plain(left, right)
    got = joins.token_subset(frame(left, "id", "s"), frame(right, "rid", "t"), ["y"], "s", "t", "id", "rid").collect()
    assert len(want) > 5 and len(got) == len(want) and {(r.id, r.rid) for r in got} == want


def joined_rows(df):
    """Rows that all joins of a plan that has run made together."""
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        if kind.endswith("JoinExec"):
            total += node.metrics().apply("numOutputRows").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_token_subset_does_not_pair_copies(spark):
    """2,000 x 2,000 copies are 4,000,000 pairs of rows, but one pair of classes."""
    many = lambda n, id_, s: spark.range(n).select(F.col("id").alias(id_), F.lit(1).alias("y"), F.split(F.lit("cup final"), " ").alias(s))
    out = joins.token_subset(many(2000, "id", "s"), many(2000, "rid", "t"), ["y"], "s", "t", "id", "rid")
    assert out.collect() == [] and 0 < joined_rows(out) < 10_000
    assert joins.token_subset(many(2000, "id", "s"), many(1, "rid", "t"), ["y"], "s", "t", "id", "rid").count() == 2000


def test_token_subset_and_coalesce_join(spark):
    a = spark.createDataFrame([(1, ["summer", "bash"]), (2, ["cup"])], "id int, s array<string>").withColumn("y", F.lit(2000))
    b = spark.createDataFrame([(5, ["summer", "bash", "two"]), (6, ["cup", "a"]), (7, ["cup", "b"])], "rid int, t array<string>").withColumn("y", F.lit(2000))
    assert rows(joins.token_subset(a, b, ["y"], "s", "t", "id", "rid"), "id") == [(1, 5)]
    left = spark.createDataFrame([(1, "x"), (None, "x"), (3, None)], "nr int, w string")
    right = spark.createDataFrame([(1, "q", "one"), (2, "x", "two")], "nr int, w string, v string")
    assert rows(joins.coalesce_join(left, right, ["nr", "w"], "v").select("nr", "w", "v"), "nr") == [(None, "x", "two"), (1, "x", "one"), (3, None, None)]


def test_outcome_precedence(spark):
    p = [(1, 1, True, None, "A"), (1, 2, False, None, "B"), (2, 1, True, "draw", "A"), (2, 2, None, "draw", "B"), (3, 1, True, None, "A"), (3, 2, None, "no_contest", "B"), (4, 1, None, None, "A")]
    df = spark.createDataFrame(p, "match_id int, team_number int, was_winner boolean, match_outcome string, name string")
    assert [r.outcome for r in rollup.match_outcomes(df).orderBy("match_id", "team_number").collect()] == ["W", "L", "D", "D", "NC", "NC", "NC"]
    assert rows(rollup.rivalries(df.where("match_id = 1")), "a") == [("A", "B", 1), ("B", "A", 1)]


def test_title_wins_and_labels(spark):
    r = spark.createDataFrame([("w", ["A"], True), ("w", ["A"], False), ("t", ["A", "B"], False)], "lineage string, champion_names array<string>, pre_corpus boolean")
    assert rows(rollup.title_wins(r), "name", "lineage") == [("A", "t", 1), ("A", "w", 1), ("B", "t", 1)]
    names = spark.createDataFrame([("Club (A and B)",), ("Gang (A and Q)",)], "name string")
    assert rows(rollup.group_labels(names, spark.createDataFrame([("A",), ("B",)], "name string")), "label") == [("Club",)]


def test_credits(spark):
    c = spark.createDataFrame([("x",), (None,)], "primary_source string")
    h = spark.createDataFrame([(["x#2", ""],)], "sources array<string>")
    assert [tuple(r) for r in rollup.source_credits(c, h).collect()] == [("Wikipedia", 2), ("x", 2)]


def test_merge_policies_and_conflicts(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "id int, x string, y string")
    new = spark.createDataFrame([(1, "z", "q"), (3, "n", None)], "id int, x string, y string")
    assert rows(reconcile.fill_nulls(old, new, ["id"]), "id") == [(1, "a", "q"), (2, "b", "c"), (3, "n", None)]
    assert rows(reconcile.merge(old, new, ["id"], {"x": "overwrite", "y": "keep"}), "id")[0] == (1, "z", "q")
    assert rows(reconcile.conflicts(old, new, ["id"], ["x", "y"]), "id") == [(1, "x", "a", "z")]


def test_stable_ids(spark):
    cur = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    prior = spark.createDataFrame([(4, "a")], "id long, k string")
    assert rows(reconcile.stable_ids(cur, prior, ["k"], spark.createDataFrame([(9,)], "top long")), "k") == [("a", 4), ("b", 10), ("c", 11)]
    table = spark.createDataFrame([(5, "x")], "id long, name string")
    assert rows(reconcile.get_or_create(spark.createDataFrame([("y",), ("x",)], "name string"), table, "name", "id"), "id") == [(5, "x"), (6, "y")]


def test_append_and_range(spark):
    base = spark.createDataFrame([(D(2019, 1, 1), None, "t")], "d date, s string, n string")
    new = spark.createDataFrame([(D(2019, 1, 1), None, "t"), (D(2020, 1, 1), None, "t")], "d date, s string, n string")
    assert reconcile.append_new(base, new, ["d", "s", "n"], ["n"]).count() == 2
    assert reconcile.replace_range(new, base.limit(0), F.year("d") >= 2020).count() == 1


def test_verdicts(spark):
    a = lambda *x: list(x)
    data = [(1, None, a("A"), a("A"), "lineup", True), (2, a("A"), a("B"), a("A"), "result", True), (3, a("A"), a("B"), a("B"), "result", False), (4, a("A"), a("B"), None, "lineup", True), (5, a("A"), a("B"), a("C"), "lineup", True)]
    df = spark.createDataFrame(data, "i int, o array<string>, h array<string>, t array<string>, k string, c boolean")
    assert [r.v for r in df.select("i", reconcile.verdict(F.col("o"), F.col("h"), F.col("t"), F.col("k"), F.col("c")).alias("v")).orderBy("i").collect()] == ["add", "keep", "fix", "review", "review"]


def test_patches_check_their_guard(spark):
    r = spark.createDataFrame([(1, "A beats B", "x", 1), (2, "C", "y", 2)], "id int, raw string, title string, n int")
    p = spark.createDataFrame([(1, "A beats", "title", "new"), (1, "A beats", "n", "7")], "id int, guard_text string, field string, value string")
    assert rows(reconcile.patch(r, p, "id", "raw", ["title", "n"]), "id") == [(1, "A beats B", "new", 7), (2, "C", "y", 2)]
    with pytest.raises(Exception, match="does not fit"):
        reconcile.patch(r, p.withColumn("guard_text", F.lit("Z")), "id", "raw", ["title", "n"]).collect()


def test_greedy_pairs_use_each_once():
    assert reconcile.greedy_pairs([["A", "B"], ["A", "C"]], [["A", "C"], ["A", "B"]]) == [(0, 1, 1.0), (1, 0, 1.0)]
    assert reconcile.greedy_pairs([], [["A"]]) == []


def test_compare_cards(spark):
    side = "array<struct<sides:array<array<string>>,winner:int>>"
    mine = [([["A"], ["B"]], 0), ([["C"], ["D"]], 0), ([["E"], ["F"]], 0)]
    other = [([["A"], ["B"]], 1), ([["C"], ["D", "X"]], 0), ([["G"], ["H"]], None)]
    df = spark.createDataFrame([(1, mine, other), (2, [], []), (3, None, None)], f"event_id long, ours {side}, theirs {side}")
    got = {(r["class"], r.ours, r.theirs) for r in reconcile.compare_cards(df).collect()}
    assert got == {("winner", 0, 0), ("missing_person", 1, 1), ("only_ours", 2, None), ("only_theirs", None, 2)}


def test_rulings(spark):
    r = spark.createDataFrame([("winner", 1, 2, "A def B"), ("winner", 1, None, "x")], "class string, event int, match int, line string")
    u = spark.createDataFrame([("winner", 1, 2, "A def"), ("winner", 1, None, "y")], "class string, event int, match int, prefix string")
    assert [x.line for x in reconcile.without_ruled(r, u).collect()] == ["x"]


def test_free_weeks(spark):
    x, y, z = ["A", "B"], ["C", "D"], ["E", "F"]
    e = [(1, "SD", D(2001, 1, 4), 1, "cagematch", [x, y]), (2, "SD", D(2001, 1, 4), 2, "b", [["b", "a"], z]), (3, "SD", D(2001, 1, 4), 3, "c", [["A", "C"], z]), (4, "SD", D(2001, 1, 11), 4, "cagematch", [z])]
    df = spark.createDataFrame(e, "event_id long, show_type string, air_date date, episode int, source string, matches array<array<string>>")
    assert rows(reconcile.free_weeks(df), "event_id") == [(1, D(2001, 1, 4)), (3, D(2001, 1, 18)), (4, D(2001, 1, 11))]
    assert reconcile.free_weeks(df.where("source <> 'cagematch'")).count() == 2  # no official record, no twin


def test_canonical_map(spark):
    counts = spark.createDataFrame([("The Rock", 5), ("Rock", 9), ("Old Name", 2), ("New Name", 1), ("Édge", 1), ("Edge", 3), ("Kane", 1)], "name string, n int")
    alias = spark.createDataFrame([("Old Name", "New Name")], "alias string, target string")
    safe = spark.createDataFrame([("Kane",)], "name string")
    got = dict(rows(entity.canonical_map(counts, aliases=alias, protected=safe), "name"))
    assert got == {"The Rock": "Rock", "Rock": "Rock", "Old Name": "Old Name", "New Name": "Old Name", "Édge": "Edge", "Edge": "Edge", "Kane": "Kane"}


def test_workers(spark):
    m = spark.createDataFrame([(1, "Édge"), (1, "Al")], "event_id int, name string")
    cast = spark.createDataFrame([(1, "Edge", 7), (1, "Al", 1), (1, "Al", 2)], "event_id int, name string, worker int")
    hist = spark.createDataFrame([(2, 50)], "worker int, n int")
    assert rows(entity.resolve_workers(m, cast, hist), "name") == [(1, "Al", 2, "exact"), (1, "Édge", 7, "key")]
    assert entity.shared_names(cast).count() == 1


def test_gates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert gates.duplicates(a, ["id"]).count() == 1
    with pytest.raises(gates.GateError):
        gates.require_empty(gates.duplicates(a, ["id"]), "ids")
    assert gates.orphans(a, a.where("id = 1"), "id").count() == 1
    assert gates.conservation(a, a, "id").isEmpty() and not gates.conservation(a, a.limit(1), "id").isEmpty()
    with pytest.raises(gates.GateError):
        gates.require_agreement(gates.agreement(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), F.col("a"), F.col("b"), 0.3))


TEAM = "struct<team_number:int,team_name:string,participants:array<string>,was_winner:boolean,match_outcome:string>"
CARD = f"event_id long, air_date date, matches array<struct<match_order:int,match_type:string,stipulation:string,title_at_stake:string,teams:array<{TEAM}>>>"


def card(kind, *sides, stake=None):
    return [(1, D(2001, 1, 1), [(1, kind, None, stake, [(i + 1, "t", list(s), i == 0, None) for i, s in enumerate(sides)])])]


def test_cards(spark):
    df = spark.createDataFrame(card("Triple Threat", ["A"], ["B", "C"], stake='World Championship "Cage"'), CARD)
    fixed = df.withColumn("matches", F.transform("matches", cards.split_fused))
    assert [t.participants for t in fixed.first().matches[0].teams] == [["A"], ["B"], ["C"]]
    assert [t.participants for t in fixed.withColumn("matches", F.transform("matches", cards.split_fused)).first().matches[0].teams] == [["A"], ["B"], ["C"]]
    assert rows(cards.search_index(fixed), "event_id") == [(1, 1, "A vs B vs C", 'Triple Threat · World Championship "Cage"')]
    assert cards.label_stakes(df).first().matches[0].belt_label == "World Title"
    assert cards.flatten(df).count() == 3
    assert cards.people_of_events(df).first().people is not None
    held = cards.belt_holders(df, spark.createDataFrame([("A", "W", D(2000, 1, 1), None), ("B", "W", D(2001, 1, 1), None)], "name string, title string, start date, end date"))
    assert rows(held, "name") == [(1, "A", ["W"])]


def test_labels_leave_sides(spark):
    df = spark.createDataFrame(card("Tag", ["Club", "A", "B"], ["Club", "Z"]), CARD)
    assert [t.participants for t in cards.without_labels(df, ["Club"]).first().matches[0].teams] == [["A", "B"], ["Club", "Z"]]


def test_show_types(spark):
    df = spark.createDataFrame([("Monday Raw", "TV"), ("Best of Raw", "TV"), ("Big One", "Pay Per View")], "t string, k string")
    assert [r.c for r in df.select(cards.show_type("t", "k").alias("c")).collect()] == ["RAW", "SKIP", "PPV"]
    with pytest.raises(Exception, match="no known class"):
        spark.createDataFrame([("?", "?")], "t string, k string").select(cards.show_type("t", "k")).collect()
