"""The rebuild of all derived tables from cards: clean, derive, check, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cards, entity, gates, rollup, timeline
from ..operators.lineage import cut


def cleaned(events: DataFrame, labels: list[str]) -> DataFrame:
    """The passes in their order: names, fused sides, group labels.  The order matters."""
    split = cards.clean(events).withColumn("matches", F.transform("matches", cards.split_fused))
    return cards.without_labels(split, labels)


# Ids of shows that replay matches of other nights; only the walk passes them over.
CLIP_SHOWS = [221, 471, 770, 831]


def steps(events: DataFrame, lineages: DataFrame | None = None, names: DataFrame | None = None, clips: list[int] = CLIP_SHOWS) -> DataFrame:
    """Title matches of cards (columns of schema.CARD) as steps of the reign walk.

    lineages: (belt, lineage, lo, hi), the lineages of a belt's name by date; a belt without one is a lineage
    by its words.  names: (name, canonical), under which champions are compared.  Shows of ``clips``, rounds
    before a final and nights of a series without a marked change are no steps.
    """
    m = events.where("air_date IS NOT NULL").where(~F.col("event_id").isin(clips)).select("event_id", F.col("air_date").alias("day"), F.explode("matches").alias("m"))
    raw, kind, finish = (F.coalesce(f"m.{c}", F.lit("")) for c in ("raw_description", "match_type", "result_method"))
    flagged = lambda t: F.coalesce(t["was_champion_entering"], F.lit(False))
    champions, won = F.filter("m.teams", flagged), F.get(F.filter("m.teams", lambda t: F.coalesce(t["was_winner"], F.lit(False))), F.lit(0))
    m = m.where(~kind.rlike(text.NON_FINAL_STAGE) & ~(kind.rlike(text.SERIES_NIGHT) & ~F.upper(raw).contains("TITLE CHANGE")))
    parts = text.belt_parts("m.title_at_stake", F.col("m.match_type"), F.upper(raw).contains("TITLE CHANGE") | (F.size(champions) > 0))
    b = m.withColumn("_parts", parts).withColumn("belts", F.size("_parts")).withColumn("belt", F.explode(F.array_distinct("_parts")))
    if lineages is not None:
        inside = (F.col("belt") == F.col("_b")) & (F.col("lo").isNull() | (F.col("day") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("day") <= F.col("hi")))
        b = b.join(lineages.withColumnRenamed("belt", "_b"), inside, "left").withColumn("lineage", F.coalesce("lineage", text.belt_key("belt")))
    else:
        b = b.withColumn("lineage", text.belt_key("belt"))
    people = lambda teams: F.flatten(F.transform(teams, lambda t: t["participants"]))
    side, first = won["match_outcome"], F.get(champions, F.lit(0))
    of_belt = F.filter("m.title_result", lambda r: r["title"].isNull() | (text.belt_key(r["title"]) == text.belt_key("belt")))
    ruling = F.get(of_belt, F.lit(0))
    out = b.dropDuplicates(["event_id", "m", "lineage"]).select(
        "lineage", "day", "event_id", F.col("m.match_order").cast("double").alias("match_order"), F.col("m.match_order").cast("long").alias("seq"), F.lit("match").alias("kind"),
        won["participants"].alias("winners"), people("m.teams").alias("people"), first["participants"].alias("defenders"), people(champions).alias("entering"), F.size(champions).alias("champion_sides"),
        text.members(first["accompaniment"]).alias("corner"), text.members(won["accompaniment"]).alias("winner_corner"), flagged(won).alias("winner_defends"),
        raw.rlike(text.CHANGE_MARK).alias("marked"), (~(F.coalesce(side.isin("win_dq", "win_countout"), F.lit(False)) | F.lower(finish).rlike("dq|disqualif|count ?out"))).alias("decisive"), "belts", F.col("belt").contains("Tag").alias("tag"),
        ruling["champions"].alias("ruling"), ruling["within"].alias("within"), F.lit(None).cast("date").alias("holds_until"), text.stand_ins(raw).alias("replaced"),
    )
    if names is None:
        return out.withColumn("alike", F.lit(None).cast("map<string,string>"))
    said = out.select("lineage", F.explode(F.array_union("people", F.flatten(F.array(F.coalesce("ruling", F.array().cast("array<string>")), F.coalesce("corner", F.array().cast("array<string>")))))).alias("name")).distinct()
    other = said.join(names, "name").where("name <> canonical").groupBy("lineage").agg(F.map_from_entries(F.collect_list(F.struct("name", "canonical"))).alias("_alike"))
    at_first = F.row_number().over(Window.partitionBy("lineage").orderBy("day", "event_id", "seq")) == 1
    return out.withColumn("_first", at_first).join(other, "lineage", "left").withColumn("alike", F.when(F.col("_first"), F.col("_alike"))).drop("_first", "_alike")


def rebuild(events: DataFrame, labels: list[str] = (), lineages: DataFrame | None = None, offcard: DataFrame | None = None) -> dict[str, DataFrame]:
    """All derived tables of cards: names, cards, reigns, intervals, people, wins, holders, search.

    offcard: more steps (columns of timeline.STEPS); only those of lineages that cards have count.  People, wins,
    intervals and holders are told by canonical name, cards and reigns as the sources spell them.
    Checks run before anything is returned.
    """
    fixed = cut(cleaned(events, list(labels)))
    people = cards.flatten(fixed).where(~text.is_placeholder("name"))
    names = cut(entity.canonical_map(people.groupBy("name").agg(F.count("*").alias("n"))))
    walk = steps(fixed, lineages, names)
    if offcard is not None:
        walk = walk.unionByName(offcard.join(walk.select("lineage").distinct(), "lineage", "left_semi"), allowMissingColumns=True)
    reigns = cut(timeline.reign_walk(walk, corpus_end=fixed.agg(F.max("air_date")).first()[0]))
    excused = F.coalesce("closed_at_retirement", F.lit(False)) | F.coalesce("vacated", F.lit(False)) | F.coalesce("beside_interim", F.lit(False))
    gates.require_empty(timeline.chain_problems(reigns, ["lineage"], excused), "reign chains")
    intervals = timeline.interval_index(reigns, "lineage").withColumnRenamed("lineage", "title")
    person = lambda df: df.join(names, "name", "left").withColumn("name", F.coalesce("canonical", "name")).drop("canonical")
    intervals, people = person(intervals), person(people)
    matches = people.withColumn("match_id", F.struct("event_id", "match_order"))
    index = rollup.match_outcomes(matches).groupBy("name").agg(F.count("*").alias("n"), *(F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("W", "L", "D", "NC")), F.min("air_date").alias("first_d"), F.max("air_date").alias("last_d"))
    gates.require_empty(gates.outcome_sums(index), "outcome sums")
    return {"names": names, "cards": cards.label_stakes(fixed), "reigns": reigns, "intervals": intervals, "people": index, "wins": person(rollup.title_wins(reigns)).groupBy("name", "lineage").agg(F.sum("wins").alias("wins")), "holders": cards.belt_holders(fixed, intervals, names), "search": cards.search_index(fixed)}
