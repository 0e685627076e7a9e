"""Per-person statistics, pair counts, top-k lists and choices of one value per group.

All of them are aggregates with partial sums before the shuffle, or windows with explicit tie-breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_outcomes(participants: DataFrame) -> DataFrame:
    """Adds outcome (W, L, D, NC) to rows (match_id, team_number, was_winner, match_outcome, name).

    Precedence within a match: any no-contest, then any draw, then the own side's flag, else NC.
    """
    w = Window.partitionBy("match_id")
    none = F.max(F.when(F.col("match_outcome") == "no_contest", 1).otherwise(0)).over(w) == 1
    draw = F.max(F.when(F.col("match_outcome") == "draw", 1).otherwise(0)).over(w) == 1
    return participants.withColumn("outcome", F.when(none, "NC").when(draw, "D").when(F.col("was_winner"), "W").when(~F.col("was_winner"), "L").otherwise("NC"))


def person_index(rows: DataFrame, person: str, outcome: Column, day: str, least: int = 10, win: str = "W", loss: str = "L", draw: str = "D") -> DataFrame:
    """person, n, w, l, d, first_d, last_d, permille (wins per thousand, rounded; null below ``least``)."""
    count = lambda v: F.count_if(outcome == v)
    agg = rows.groupBy(person).agg(F.count("*").alias("n"), count(win).alias("w"), count(loss).alias("l"), count(draw).alias("d"), F.min(day).alias("first_d"), F.max(day).alias("last_d"))
    return agg.withColumn("permille", F.when(F.col("n") >= least, F.floor((2000 * F.col("w") + F.col("n")) / (2 * F.col("n")))))


def main_events(matches: DataFrame, event: str = "event_id", order: str = "match_order") -> DataFrame:
    """Adds is_main: the match is the last of its event."""
    return matches.withColumn("is_main", F.col(order) == F.max(order).over(Window.partitionBy(event)))


def appearances(rows: DataFrame, person: str = "name") -> DataFrame:
    """person, events, ppvs, mains of rows (name, event_id, is_ppv, is_main)."""
    return rows.groupBy(person).agg(F.countDistinct("event_id").alias("events"), F.countDistinct(F.when(F.col("is_ppv"), F.col("event_id"))).alias("ppvs"), F.count_if("is_main").alias("mains"))


def first_best(rows: DataFrame, keys: list[str], order: list, keep: list[str]) -> DataFrame:
    """One row of each key: the first in the given order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").select(*keys, *keep)


def top_k(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key in the given order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def pair_counts(rows: DataFrame, group: str, member: str, first: str = "s1", second: str = "s2") -> DataFrame:
    """How many groups two members share, in both directions.

    The members of a group are paired within the group's own set, so only one shuffle by group is
    needed; the counts are summed partially before the second.  Groups are cards: small by nature.
    """
    sets = rows.groupBy(group).agg(F.sort_array(F.collect_set(member)).alias("_m")).where(F.size("_m") > 1)
    a = sets.select(F.explode("_m").alias("_a"), "_m")
    pairs = a.select("_a", F.explode(F.filter("_m", lambda x: x > F.col("_a"))).alias("_b")).groupBy("_a", "_b").agg(F.count("*").alias("n"))
    both = F.explode(F.array(F.struct(F.col("_a").alias("x"), F.col("_b").alias("y")), F.struct(F.col("_b").alias("x"), F.col("_a").alias("y"))))
    return pairs.select(both.alias("_p"), "n").select(F.col("_p.x").alias(first), F.col("_p.y").alias(second), "n")


def rivalries(participants: DataFrame) -> DataFrame:
    """a, b, n: singles matches of two sides with one person each, both directions."""
    sides = participants.groupBy("match_id", "team_number").agg(F.collect_set("name").alias("p"))
    duels = sides.groupBy("match_id").agg(F.collect_list("p").alias("s")).where((F.size("s") == 2) & (F.size(F.col("s")[0]) == 1) & (F.size(F.col("s")[1]) == 1))
    two = F.explode(F.array(F.struct(F.col("s")[0][0].alias("a"), F.col("s")[1][0].alias("b")), F.struct(F.col("s")[1][0].alias("a"), F.col("s")[0][0].alias("b"))))
    return duels.select(two.alias("d")).groupBy(F.col("d.a").alias("a"), F.col("d.b").alias("b")).agg(F.count("*").alias("n"))


def most_common(rows: DataFrame, keys: list[str], value: str, when: str) -> DataFrame:
    """The most frequent value of each key; ties go to the latest, then the greatest value."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.max(when).alias("_d"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_n", "_d", value)).alias(value))


def modal(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key (ties: the least), e.g. a learned episode offset."""
    counts = rows.groupBy(*keys, value).count()
    return first_best(counts, keys, [F.desc("count"), F.col(value)], [value])


def decisive(rows: DataFrame, key: str, value: str, factor: int = 2, otherwise: str = "undecided") -> DataFrame:
    """The most frequent value, if it has ``factor`` times the runner-up's count or no rival."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy(F.desc("_n"), value)
    ranked = counts.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead("_n").over(w)).where("_k = 1")
    return ranked.select(key, F.when(F.col("_next").isNull() | (F.col("_n") >= factor * F.col("_next")), F.col(value)).otherwise(otherwise).alias(value))


def title_wins(reigns: DataFrame, lineage: str = "lineage") -> DataFrame:
    """name, lineage, wins of reigns (champion_names, pre_corpus); reigns from before the corpus do not count."""
    rows = reigns.where("NOT pre_corpus").select(F.explode("champion_names").alias("name"), lineage)
    return rows.groupBy("name", lineage).agg(F.count("*").alias("wins"))


def best_first(rows: DataFrame, rating: str, votes: str, *ties: str) -> list[Column]:
    """An order by rating, unrated last, then votes (null is 0), then names."""
    return [F.desc_nulls_last(rating), F.coalesce(F.col(votes), F.lit(0)).desc(), *(F.col(t) for t in ties)]


def source_credits(cards: DataFrame, histories: DataFrame, default: str = "Wikipedia") -> DataFrame:
    """source, n: cards by primary source and citations of histories (``#n`` stripped), most used first."""
    a = cards.select(F.coalesce("primary_source", F.lit(default)).alias("source"))
    b = histories.select(F.explode("sources").alias("source")).select(F.coalesce(F.nullif(F.trim(F.regexp_replace("source", "#.*$", "")), F.lit("")), F.lit(default)).alias("source"))
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def group_labels(names: DataFrame, competitors: DataFrame) -> DataFrame:
    """label: names written "L (M1 and M2)" of which every member competes somewhere (column name)."""
    parts = names.select("name", F.regexp_extract("name", r"^(.*?)\s*\(", 1).alias("label"), F.explode(F.split(F.regexp_extract("name", r"\(([^)]*)\)", 1), r"\s*(?:,|&|\band\b)\s*")).alias("member"))
    known = parts.join(competitors.select(F.col("name").alias("member")).distinct().withColumn("_k", F.lit(True)), "member", "left")
    return known.groupBy("name", "label").agg(F.min(F.coalesce("_k", F.lit(False))).alias("all")).where("all AND label <> ''").select("label").distinct()


def coverage(matches: DataFrame, media: DataFrame, year: str = "year") -> DataFrame:
    """year, events, with_show, matches, with_video of matches (event_id, match_order, year) and media (event_id, match_order; null: the whole show)."""
    whole = media.where("match_order IS NULL").select("event_id").distinct().withColumn("_show", F.lit(True))
    single = media.where("match_order IS NOT NULL").select("event_id", "match_order").distinct().withColumn("_video", F.lit(True))
    m = matches.join(whole, "event_id", "left").join(single, ["event_id", "match_order"], "left")
    return m.groupBy(year).agg(F.countDistinct("event_id").alias("events"), F.countDistinct(F.when(F.col("_show"), F.col("event_id"))).alias("with_show"), F.count("*").alias("matches"), F.count_if(F.coalesce("_video", F.lit(False))).alias("with_video"))
