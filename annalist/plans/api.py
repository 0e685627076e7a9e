"""Read-only questions over cards, as functions that return DataFrames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cards


def health(events: DataFrame, matches: DataFrame, wrestlers: DataFrame) -> DataFrame:
    """One row: the numbers of events, matches and wrestlers."""
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(events, "events").crossJoin(one(matches, "matches")).crossJoin(one(wrestlers, "wrestlers"))


def month(events: DataFrame, matches: DataFrame, year: int, number: int) -> DataFrame:
    """Events of a month with their match counts, by date and show."""
    if not (1980 <= year <= 2100 and 1 <= number <= 12):
        raise ValueError("no such month")
    start, end = dt.date(year, number, 1), dt.date(year + number // 12, number % 12 + 1, 1)
    own = events.where((F.col("air_date") >= F.lit(start)) & (F.col("air_date") < F.lit(end)))
    n = matches.join(own.select("event_id"), "event_id", "left_semi").groupBy("event_id").agg(F.count("*").alias("match_count"))
    return own.join(n, "event_id", "left").withColumn("match_count", F.coalesce("match_count", F.lit(0))).orderBy("air_date", "show_type")


def event(tables: dict[str, DataFrame], event_id: int) -> DataFrame:
    """The nested card of one event (no row: there is none)."""
    own = tables["events"].where(F.col("event_id") == event_id)
    matches = tables["matches"].where(F.col("event_id") == event_id)
    teams = tables["match_teams"].join(matches.select("match_id"), "match_id", "left_semi")
    people = tables["match_participants"].join(teams.select("team_id"), "team_id", "left_semi")
    return cards.nest_cards(own, matches, teams, people, tables["wrestlers"])
