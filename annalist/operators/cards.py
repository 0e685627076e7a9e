"""Cards: events with nested matches, sides and people; their flat form, and repairs of sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def nest(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Parents with their children as an array of structs in order (empty if there are none).

    The order columns come first in the structs, so sort_array sorts by them.
    """
    rest = [c for c in children.columns if c != key and c not in order]
    grouped = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))
    out = parents.join(grouped, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


def nest_cards(events: DataFrame, matches: DataFrame, teams: DataFrame, participants: DataFrame, people: DataFrame) -> DataFrame:
    """events with matches[] with teams[] with participants[] (canonical names where known, else cleaned ones)."""
    named = participants.join(people.select("wrestler_id", "canonical_name"), "wrestler_id", "left")
    named = named.select("team_id", "participant_order", F.coalesce("canonical_name", text.clean_participant(text.canonical_name("wrestler_name_used"))).alias("name")).where("name IS NOT NULL")
    sides = nest(teams, named, "team_id", ["participant_order"], "_p").withColumn("participants", F.transform("_p", lambda x: x["name"])).drop("_p")
    bouts = nest(matches, sides, "match_id", ["team_number"], "teams")
    return nest(events, bouts, "event_id", ["match_order"], "matches").withColumn("match_count", F.size("matches"))


def flatten(cards: DataFrame) -> DataFrame:
    """One row for each person of each side: event_id, air_date, match_order, team_number, was_winner, match_outcome, name, seq."""
    m = cards.select("event_id", "air_date", F.explode("matches").alias("m"))
    t = m.select("event_id", "air_date", F.col("m.match_order").alias("match_order"), F.explode("m.teams").alias("t"))
    return t.select("event_id", "air_date", "match_order", F.col("t.team_number").alias("team_number"), F.col("t.was_winner").alias("was_winner"), F.col("t.match_outcome").alias("match_outcome"), F.posexplode("t.participants").alias("seq", "name"))


def people(match: Column | str) -> Column:
    """All people of a match struct."""
    return F.flatten(F.transform(text.col(match)["teams"], lambda t: t["participants"]))


def people_of_events(cards: DataFrame) -> DataFrame:
    """event_id, people: the set of identity keys of each card."""
    return cards.select("event_id", F.explode(F.flatten(F.transform("matches", people))).alias("p")).groupBy("event_id").agg(F.collect_set(text.normkey("p")).alias("people"))


def clean(cards: DataFrame) -> DataFrame:
    """Cards with clean names on every side; what names nobody goes."""
    side = lambda t: t.withField("participants", text.clean_participants(F.transform(t["participants"], text.canonical_name)))
    return cards.withColumn("matches", F.transform("matches", lambda m: m.withField("teams", F.transform(m["teams"], side))))


def split_fused(match: Column | str) -> Column:
    """A match whose type declares n sides, told as two, the second with n - 1 people: each of these is a side of its own.

    A side named as a tag team (no comma or ampersand list of exactly that size) stays.
    """
    m = text.col(match)
    n = text.declared_sides(m["match_type"])
    last = m["teams"][1]
    fused = n.isNotNull() & (F.size(m["teams"]) == 2) & (F.size(m["teams"][0]["participants"]) == 1) & (F.size(last["participants"]) == n - 1)
    first = m["teams"][0]
    singles = F.transform(last["participants"], lambda p, i: last.withField("team_number", (i + 2).cast("int")).withField("team_name", p).withField("participants", F.array(p)))
    return F.when(fused, m.withField("teams", F.concat(F.array(first), singles))).otherwise(m)


def without_labels(cards: DataFrame, labels: list[str]) -> DataFrame:
    """Cards without group labels that stand beside two or more people of a side (the labels are a small, fixed list)."""
    names = F.array(*(F.lit(x) for x in labels)) if labels else F.array().cast("array<string>")
    side = lambda t: t.withField("participants", F.when(F.size(F.array_except(t["participants"], names)) >= 2, F.filter(t["participants"], lambda p: ~F.array_contains(names, p))).otherwise(t["participants"]))
    return cards.withColumn("matches", F.transform("matches", lambda m: m.withField("teams", F.transform(m["teams"], side))))


def label_stakes(cards: DataFrame) -> DataFrame:
    """Adds belt_label and stake_note to every match."""
    return cards.withColumn("matches", F.transform("matches", lambda m: m.withField("belt_label", text.stake_label(m["title_at_stake"])["label"]).withField("stake_note", text.stake_label(m["title_at_stake"])["note"])))


def belt_holders(cards: DataFrame, reigns: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """event_id, name, titles: belts that people of a card held on its day (start < day <= end, or open).

    reigns: name, title, start, end.  names: (name, canonical), if the reigns are told by canonical name.
    """
    who = flatten(cards).select("event_id", "air_date", "name").distinct()
    if names is not None:
        who = who.join(names, "name", "left").select("event_id", "air_date", F.coalesce("canonical", "name").alias("name")).distinct()
    held = who.join(reigns, "name").where((F.col("start") < F.col("air_date")) & (F.col("end").isNull() | (F.col("air_date") <= F.col("end"))))
    return held.groupBy("event_id", "name").agg(F.sort_array(F.collect_set("title")).alias("titles"))


def calendar(events: DataFrame) -> DataFrame:
    """air_date, ids: the sorted ids of each date."""
    return events.groupBy("air_date").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))


def search_index(cards: DataFrame) -> DataFrame:
    """event_id, match_order, matchup ("A & B vs C"), detail (type, stipulation and title, what is there)."""
    m = cards.select("event_id", F.explode("matches").alias("m"))
    side = lambda t: F.array_join(t["participants"], " & ")
    return m.select("event_id", F.col("m.match_order").alias("match_order"), F.array_join(F.transform("m.teams", side), " vs ").alias("matchup"), F.concat_ws(" · ", "m.match_type", "m.stipulation", "m.title_at_stake").alias("detail"))


# Rules that tell a show's class from its title and type, in order.
SHOW_RULES = [("(?i)clip show|best of|recap", "SKIP"), ("(?i)pay per view|premium live event|ppv", "PPV"), ("(?i)\\braw\\b", "RAW"), ("(?i)smack ?down", "SD"), ("(?i)\\bnxt\\b", "NXT"), ("(?i)\\becw\\b", "ECW")]


def show_type(title: Column | str, kind: Column | str) -> Column:
    """The class of a show; SKIP for shows that are none; an unknown one fails the job."""
    both = F.concat_ws(" | ", text.col(kind), text.col(title))
    found = text.first_keyword(both, SHOW_RULES)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("a show of no known class: "), both)))
