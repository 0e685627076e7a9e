"""Schemas of the relational and the nested form, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import gates

# The tables of the relational form.
TABLES = {
    "events": "event_id long, air_date date, tape_date date, show_type string, title string, ppv_name string, episode_number int, venue string, city string, region string, country string, attendance int, tv_rating double, date_derivation string, primary_source string, verification_status string, source_url string",
    "matches": "match_id long, event_id long, match_order int, match_type string, stipulation string, title_at_stake string, duration_seconds int, match_guide_rating double, result_method string, parse_confidence string, raw_description string",
    "match_teams": "team_id long, match_id long, team_number int, team_name string, accompaniment string, was_winner boolean, match_outcome string, was_champion_entering boolean",
    "match_participants": "team_id long, participant_order int, wrestler_id long, wrestler_name_used string",
    "wrestlers": "wrestler_id long, canonical_name string, ring_names array<string>",
    "sources": "event_id long, source_name string, source_url string, notes string",
}
# Columns with a closed set of values.
ENUMS = {("matches", "parse_confidence"): ["high", "low"], ("match_teams", "match_outcome"): ["win", "loss", "draw", "no_contest", "win_dq", "loss_dq", "win_countout", "loss_countout"]}
#: Keys that no two rows share.
UNIQUE = {"events": ["event_id"], "matches": ["event_id", "match_order"], "match_teams": ["match_id", "team_number"], "wrestlers": ["canonical_name"]}

TEAM = "struct<team_number:int,team_name:string,accompaniment:string,was_winner:boolean,match_outcome:string,was_champion_entering:boolean,participants:array<string>>"
RULING = "struct<title:string,champions:array<string>,within:array<array<string>>>"
MATCH = f"struct<match_order:int,match_type:string,stipulation:string,title_at_stake:string,duration_seconds:int,result_method:string,match_guide_rating:double,raw_description:string,teams:array<{TEAM}>,title_result:array<{RULING}>>"
CARD = f"event_id long, air_date date, show_type string, title string, matches array<{MATCH}>"


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """The tables, where they are not there yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def check(tables: dict[str, DataFrame]) -> None:
    """Fails on values outside of closed sets and on shared keys, before anything is built."""
    for (table, column), allowed in ENUMS.items():
        if table in tables:
            gates.require_empty(gates.not_in_set(tables[table], column, allowed), f"{table}.{column}")
    for table, keys in UNIQUE.items():
        if table in tables:
            gates.require_empty(gates.duplicates(tables[table], keys), f"keys of {table}")
