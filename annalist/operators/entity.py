"""Entity resolution: one identity and one display name for the spellings of a person."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normkey
from .rollup import first_best


def canonical_map(counts: DataFrame, aliases: DataFrame | None = None, curated: DataFrame | None = None, protected: DataFrame | None = None, display: DataFrame | None = None) -> DataFrame:
    """name, canonical for all names of counts (name, n).

    Pass 1, identity: a protected name (column name) is itself; else the curated target (alias, target),
    else a roster alias by key (alias, target), else the most used spelling of the name's key.
    Pass 2, display: of an identity's spellings the most used one (ties: the identity's own key, then the
    greater name); display (name, shown) has the last word; protected names keep theirs.
    """
    spark = counts.sparkSession
    empty = spark.createDataFrame([], "alias string, target string")
    keyed = lambda df: df.withColumn("key", normkey("alias")).groupBy("key").agg(F.max("target").alias("target"))
    names = counts.groupBy("name").agg(F.sum("n").alias("n")).withColumn("key", normkey("name"))
    safe = (protected if protected is not None else spark.createDataFrame([], "name string")).select("name").distinct().withColumn("safe", F.lit(True))
    modal = first_best(names, ["key"], [F.desc("n"), F.desc("name")], ["name"]).withColumnRenamed("name", "modal")
    c, r = keyed(curated if curated is not None else empty).withColumnRenamed("target", "ct"), keyed(aliases if aliases is not None else empty).withColumnRenamed("target", "rt")
    one = names.join(safe, "name", "left").join(c, "key", "left").join(r, "key", "left").join(modal, "key", "left")
    identity = F.when(F.col("safe"), F.col("name")).otherwise(F.coalesce("ct", "rt", "modal"))
    one = one.withColumn("identity", identity).withColumn("ikey", normkey("identity"))
    shown = first_best(one.where("safe IS NULL"), ["ikey"], [F.desc("n"), F.desc(F.col("key") == F.col("ikey")), F.desc("name")], ["name"]).withColumnRenamed("name", "best")
    fixes = (display if display is not None else spark.createDataFrame([], "name string, shown string")).withColumnRenamed("name", "best")
    out = one.join(shown, "ikey", "left").join(fixes, "best", "left")
    return out.select("name", F.when(F.col("safe"), F.col("name")).otherwise(F.coalesce("shown", "best", "identity")).alias("canonical"))


def resolve_workers(mentions: DataFrame, cast: DataFrame, history: DataFrame) -> DataFrame:
    """event_id, name, worker, rule: mentions (event_id, name) by the event's cast (event_id, name, worker).

    Exact names first, then keys; of several workers the one with most history (worker, n), then the least.
    """
    m = mentions.select("event_id", "name").distinct().withColumn("key", normkey("name"))
    c = cast.withColumn("key", normkey("name")).join(history, "worker", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pick = lambda df, rule: first_best(df, ["event_id", "name"], [F.desc("n"), F.col("worker")], ["worker"]).withColumn("rule", F.lit(rule))
    exact = pick(m.join(c.drop("key"), ["event_id", "name"]), "exact")
    rest = m.join(exact, ["event_id", "name"], "left_anti")
    return exact.unionByName(pick(rest.join(c.drop("name"), ["event_id", "key"]), "key"))


def shared_names(usage: DataFrame) -> DataFrame:
    """Names that more than one worker uses (name, worker)."""
    return usage.groupBy("name").agg(F.countDistinct("worker").alias("workers")).where("workers > 1")


def keepers(rows: DataFrame, id_: str, canonical: str) -> DataFrame:
    """id, keeper: every id with the least id of its canonical name."""
    return rows.select(F.col(id_).alias("id"), F.min(id_).over(Window.partitionBy(canonical)).alias("keeper"))


def slug_aliases(names: DataFrame, canonical: DataFrame) -> DataFrame:
    """name, slug: every raw name with the slug of its canonical one (canonical: name, canonical, slug)."""
    return names.select("name").distinct().join(canonical.select("name", "slug"), "name")


def rename_pairs(pages: DataFrame) -> DataFrame:
    """alias, target: of roster pages (slug, name) those whose slug says another name; a name's own target wins over a slug's."""
    from ..functions.text import slugify

    pairs = pages.select(F.regexp_replace("slug", "-", " ").alias("alias"), F.col("name").alias("target"), F.lit(1).alias("_k"))
    own = pages.select(F.lower("name").alias("alias"), F.col("name").alias("target"), F.lit(0).alias("_k"))
    both = pairs.where(slugify("target") != F.regexp_replace("alias", " ", "-")).unionByName(own)
    return first_best(both, ["alias"], [F.col("_k"), F.col("target")], ["target"]).where(F.lower("target") != F.col("alias"))


def recovered_aliases(shipped: DataFrame, current: DataFrame) -> DataFrame:
    """alias, target: shipped aliases whose target has an alias of its own now go on to that (one hop); self-pointing ones go."""
    hop = current.select(F.col("alias").alias("target"), F.col("target").alias("_next"))
    return shipped.join(hop, "target", "left").select("alias", F.coalesce("_next", "target").alias("target")).where("alias <> target")


def rekeyed_assets(assets: DataFrame, aliases: DataFrame, roster: DataFrame) -> DataFrame:
    """slug, to: assets whose slug is no roster slug but an alias of one that has no asset yet."""
    orphans = assets.select("slug").join(roster.select("slug"), "slug", "left_anti")
    to = orphans.join(aliases.select(F.col("alias").alias("slug"), F.col("target").alias("to")), "slug")
    return to.join(roster.select(F.col("slug").alias("to")), "to", "left_semi").join(assets.select(F.col("slug").alias("to")), "to", "left_anti").select("slug", "to")


def find_profile(names: DataFrame, profiles: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, profile, rule: by the exact name, an alias, with or without "The ", else by initial and last word where that is unique."""
    p = profiles.select(F.col("name").alias("profile")).distinct()
    bare = lambda c: F.regexp_replace(F.lower(c), r"^the\s+", "")
    short = lambda c: F.concat(F.substring(F.lower(c), 1, 1), F.lit(" "), F.element_at(F.split(F.lower(c), " "), -1))
    lone = lambda key, name: p.groupBy(key("profile").alias("_key")).agg(F.count("*").alias("_n"), F.min("profile").alias(name)).where("_n = 1").drop("_n")
    n = names.select("name").distinct()
    out = n.join(p.withColumn("_exact", F.col("profile")).withColumnRenamed("profile", "name"), "name", "left")
    known = aliases.select(F.col("alias").alias("name"), F.col("target").alias("_alias")).join(p.withColumnRenamed("profile", "_alias"), "_alias", "left_semi")
    out = out.join(known, "name", "left")
    out = out.join(lone(bare, "_bare"), bare("name") == F.col("_key"), "left").drop("_key")
    out = out.join(lone(short, "_short"), short("name") == F.col("_key"), "left").drop("_key")
    rule = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_alias").isNotNull(), "alias").when(F.col("_bare").isNotNull(), "the").when(F.col("_short").isNotNull(), "initial")
    return out.select("name", F.coalesce("_exact", "_alias", "_bare", "_short").alias("profile"), rule.alias("rule"))


def resolved_side(mentions: DataFrame, cast: DataFrame) -> DataFrame:
    """event, mention, name, rule: a mention on a card is a name of its cast, or the only one with that last word (a surname).

    mentions: event, mention; cast: event, name.
    """
    exact = mentions.join(cast.select("event", F.col("name").alias("mention"), F.col("name").alias("_exact")).distinct(), ["event", "mention"], "left")
    last = cast.select("event", "name", F.element_at(F.split("name", r"\s+"), -1).alias("mention")).groupBy("event", "mention").agg(F.countDistinct("name").alias("_n"), F.min("name").alias("_sur")).where("_n = 1").drop("_n")
    out = exact.join(last, ["event", "mention"], "left")
    return out.select("event", "mention", F.coalesce("_exact", "_sur").alias("name"), F.when(F.col("_exact").isNotNull(), "explicit").when(F.col("_sur").isNotNull(), "surname").otherwise("unresolved").alias("rule"))


def resolved_slugs(assets: DataFrame, roster: DataFrame, manual: DataFrame, skipped: list[str]) -> DataFrame:
    """asset, slug, rule of assets (asset): a manual choice (asset, slug), the same slug, or the same letters where they name one slug; skipped ones have none."""
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    same = roster.groupBy(letters("slug").alias("_l")).agg(F.count("*").alias("_n"), F.min("slug").alias("_norm")).where("_n = 1").drop("_n")
    out = assets.select("asset").join(manual.select("asset", F.col("slug").alias("_manual")), "asset", "left").join(roster.select(F.col("slug").alias("asset"), F.col("slug").alias("_exact")), "asset", "left").join(same, letters("asset") == F.col("_l"), "left")
    skip = F.col("asset").isin(skipped) if skipped else F.lit(False)
    rule = F.when(skip, "skipped").when(F.col("_manual").isNotNull(), "manual").when(F.col("_exact").isNotNull(), "exact").when(F.col("_norm").isNotNull(), "normalized").otherwise("none")
    return out.select("asset", F.when(~skip, F.coalesce("_manual", "_exact", "_norm")).alias("slug"), rule.alias("rule"))
