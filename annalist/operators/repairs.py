"""Votes, plans and repairs of records: what several sources tell is settled as rows first, and applied afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let


def default_by_source(value: Column, other: Column, source: Column, name: str) -> Column:
    """The value, or the other one where the record comes from the named source."""
    return F.coalesce(value, F.when(source == name, other))


def tri_state(flag: Column) -> Column:
    """0, 1 or null as false, true or null."""
    return F.when(flag.isNotNull(), flag != 0)


def discovered(title: Column, day: Column, stems: list[str], weekly: list[str], first: str, last: str) -> Column:
    """keep, too_old, too_new or skip: big shows by the stems of their titles, weekly ones only with a number."""
    low = F.lower(F.trim(title))
    starts = lambda names: F.forall(F.array(*(F.lit(n.lower()) for n in names)), lambda n: ~low.startswith(n))
    wanted = ~starts(stems) | (~starts(weekly) & title.contains("#"))
    return F.when(~wanted, "skip").when(day < F.lit(first).cast("date"), "too_old").when(day > F.lit(last).cast("date"), "too_new").otherwise("keep")


def duration_flag(kind: Column, seconds: Column, part: Column) -> Column:
    """Videos whose length does not fit: a whole show under 45 minutes (unless a part of one), a match over 60 or under 1."""
    show, match = kind == "show", kind == "match"
    return F.when(show & ~part & (seconds < 45 * 60), "short_show").when(match & (seconds > 60 * 60), "long_match").when(match & (seconds < 60), "short_match")


def sole_source(rows: DataFrame, keys: list[str], source: str, day: str, corpus_end: Column) -> DataFrame:
    """keys, why: keys that one source alone tells, or that lie after the corpus."""
    told = rows.groupBy(*keys).agg(F.countDistinct(source).alias("_n"), F.min(day).alias("_d"))
    return told.withColumn("why", F.when(F.col("_d") > corpus_end, "after the corpus").when(F.col("_n") < 2, "one source")).where("why IS NOT NULL").select(*keys, "why")


def overlap_rate(rows: DataFrame, key: str, group: str) -> DataFrame:
    """shared, groups: how many groups have a key that another group has too."""
    pairs = rows.select(key, group).distinct()
    n = pairs.groupBy(key).agg(F.count("*").alias("_n"))
    return pairs.join(n, key).groupBy(group).agg(F.max(F.col("_n") > 1).alias("_s")).agg(F.count_if("_s").alias("shared"), F.count("*").alias("groups"))


def insert_after(rows: DataFrame, new: DataFrame, keys: list[str], order: str, anchor: str) -> DataFrame:
    """Rows with new ones put behind their anchors (the order of another row), all renumbered from 1.

    new: the columns of rows, and ``anchor`` in place of ``order``; several at one anchor stand in the order of their other columns.
    """
    others = [c for c in rows.columns if c not in keys and c != order]
    old = rows.select(*keys, *others, F.col(order).alias("_at"), F.lit(0).alias("_new"))
    both = old.unionByName(new.select(*keys, *others, F.col(anchor).alias("_at"), F.lit(1).alias("_new")))
    return both.withColumn(order, F.row_number().over(Window.partitionBy(*keys).orderBy("_at", "_new", *others))).select(*rows.columns)


def merged_media(old: DataFrame, new: DataFrame, keys: list[str], url: str) -> DataFrame:
    """The union of two sets of links, one of each url within a bucket; the old one stays."""
    both = old.withColumn("_k", F.lit(0)).unionByName(new.withColumn("_k", F.lit(1)))
    order = Window.partitionBy(*keys, url).orderBy("_k", *(c for c in old.columns if c not in [*keys, url]))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*old.columns)


def shared_numbers(rows: DataFrame, number: str, id_: str) -> DataFrame:
    """number, ids: foreign numbers that several of our records claim."""
    return rows.where(F.col(number).isNotNull()).groupBy(number).agg(F.countDistinct(id_).alias("ids")).where("ids > 1")


def logged(log: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """The log and the entries whose keys it does not have, each once: the same entries again change nothing."""
    return log.unionByName(entries.dropDuplicates(keys).join(log, keys, "left_anti").select(*log.columns))


def stable_children(current: DataFrame, prior: DataFrame, parent: str, place: str, top: int, id_: str = "id") -> DataFrame:
    """parent, place, id: children keep the id that the same place of the same parent had; new ones get ids above ``top`` by parent and place."""
    from .reconcile import dense_rank

    joined = current.select(parent, place).join(prior.select(parent, place, id_), [parent, place], "left")
    fresh = dense_rank(joined.where(F.col(id_).isNull()).drop(id_), [parent, place], "_k")
    return joined.where(F.col(id_).isNotNull()).unionByName(fresh.select(parent, place, (F.lit(top) + F.col("_k")).alias(id_)))


def date_votes(claims: DataFrame, event: str, day: str, source: str, ours: str) -> DataFrame:
    """event, day, votes: dates that more sources tell than tell ours; none if one source tells both, or two dates tie.

    claims: event, day, source, and our own day.
    """
    counts = claims.groupBy(event, ours, day).agg(F.countDistinct(source).alias("votes"))
    mine = F.coalesce(F.max(F.when(F.col(day) == F.col(ours), F.col("votes"))).over(Window.partitionBy(event)), F.lit(0))
    others = counts.withColumn("_mine", mine).where(F.col(day) != F.col(ours))
    w = Window.partitionBy(event).orderBy(F.desc("votes"), day)
    best = others.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead("votes").over(w)).where("_k = 1 AND votes > _mine AND (_next IS NULL OR _next < votes)")
    torn = claims.groupBy(event, source).agg(F.count_if(F.col(day) == F.col(ours)).alias("_a"), F.count_if(F.col(day) != F.col(ours)).alias("_b")).where("_a > 0 AND _b > 0").select(event).distinct()
    return best.join(torn, event, "left_anti").select(event, day, "votes")


def auto_fixes(rows: DataFrame, verdicts: list[str], order: list[str]) -> DataFrame:
    """The rows whose verdict may be applied without review, numbered in the given order."""
    from .reconcile import dense_rank

    return dense_rank(rows.where(F.col("verdict").isin(verdicts)), order, "nr")


def settled_dates(rows: DataFrame, day: str, header: str, flagged: str, id_: str) -> DataFrame:
    """id, day: a flagged row whose day another, unflagged row has takes the day of its header."""
    taken = rows.where(~F.col(flagged)).select(day).distinct().withColumn("_taken", F.lit(True))
    moved = F.col(flagged) & F.coalesce("_taken", F.lit(False)) & F.col(header).isNotNull()
    return rows.join(taken, day, "left").select(id_, F.when(moved, F.col(header)).otherwise(F.col(day)).alias(day))


def occupied(rows: DataFrame, day: str, id_: str, dropped: DataFrame) -> DataFrame:
    """day, shows: shows of each date, without dropped ids; dates that none is left on are free."""
    return rows.join(dropped.select(id_), id_, "left_anti").groupBy(day).agg(F.count("*").alias("shows"))


def only_win(rows: DataFrame, event: str, who: str, won: str, title: str, match: str) -> DataFrame:
    """event, who, match: the one match that a person won on a card; of several the only title match, else none."""
    wins = rows.where(F.col(won)).groupBy(event, who).agg(F.count("*").alias("_n"), F.count_if(title).alias("_t"), F.min(match).alias("_m"), F.min(F.when(F.col(title), F.col(match))).alias("_tm"))
    return wins.select(event, who, F.when(F.col("_n") == 1, F.col("_m")).when(F.col("_t") == 1, F.col("_tm")).alias(match)).where(F.col(match).isNotNull())


def any_overlap(a: Column, b: Column) -> Column:
    """Whether two reigns' names (champion, team label, members) share one."""
    return F.arrays_overlap(a, b)


def rewritten_result(outcome: Column, kind: Column) -> Column:
    """A side's outcome after its match's finish is corrected to a kind (pinfall, dq, countout, draw, no_contest)."""
    won = outcome.startswith("win")
    return F.when(kind.isin("draw", "no_contest"), kind).when(kind == "dq", F.when(won, "win_dq").otherwise("loss_dq")).when(kind == "countout", F.when(won, "win_countout").otherwise("loss_countout")).otherwise(F.when(won, "win").otherwise("loss"))


def moved_records(rows: DataFrame, moves: DataFrame, id_: str, fields: list[str]) -> DataFrame:
    """Rows with the fields that moves (id and some of the fields, null: as it is) give anew; an id that no row has fails the job."""
    m = moves.select(id_, *(F.col(f).alias(f"_m_{f}") for f in fields), F.lit(True).alias("_move"))
    joined = rows.withColumn("_row", F.lit(True)).join(m, id_, "full")
    checked = joined.withColumn("_row", F.when(F.col("_row").isNull(), F.raise_error(F.lit("a move has no record"))).otherwise(F.col("_row")))
    return checked.where("_row").select(*(F.coalesce(f"_m_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns))


def synthesized(rows: DataFrame, wanted: DataFrame, key: str, template: str, fields: list[str]) -> DataFrame:
    """New records (key, template: the key of a neighbour, and own fields) that take what they lack from their neighbour."""
    base = rows.select(F.col(key).alias(template), *(F.col(c).alias(f"_t_{c}") for c in rows.columns if c != key))
    own = set(fields)
    return wanted.join(base, template).select(*(F.col(key) if c == key else F.coalesce(c, f"_t_{c}").alias(c) if c in own else F.col(f"_t_{c}").alias(c) for c in rows.columns))


def cleaned_side(name: Column, people: Column, cleaned: Column) -> Column:
    """A side's cleaned name, if it still names every person; else the name as it is."""
    return let(cleaned, lambda c: F.when(F.forall(people, lambda p: c.contains(p)), c).otherwise(name))


def swapped_numbers(rows: DataFrame, pairs: DataFrame, id_: str, number: str) -> DataFrame:
    """Rows in which the records of each pair (a, b) have changed their numbers."""
    both = pairs.select(F.col("a").alias(id_), F.col("b").alias("_other")).unionByName(pairs.select(F.col("b").alias(id_), F.col("a").alias("_other")))
    other = rows.select(F.col(id_).alias("_other"), F.col(number).alias("_number"))
    return rows.join(both.join(other, "_other").select(id_, "_number"), id_, "left").withColumn(number, F.coalesce("_number", number)).select(*rows.columns)


def undone(rows: DataFrame, snapshot: DataFrame, id_: str, fields: list[str], which: DataFrame) -> DataFrame:
    """Rows with the fields of an earlier snapshot for the ids of ``which``."""
    s = snapshot.join(which.select(id_), id_, "left_semi").select(id_, *(F.col(f).alias(f"_s_{f}") for f in fields), F.lit(True).alias("_undo"))
    return rows.join(s, id_, "left").select(*(F.when(F.col("_undo"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns))


def filled_by_people(rows: DataFrame, known: DataFrame, key: str, people: str, value: str) -> DataFrame:
    """Rows whose missing value is that of the only known record of the same key with exactly the same people."""
    set_ = F.array_join(F.array_sort(F.array_distinct(people)), "|")
    lone = known.where(F.col(value).isNotNull()).select(key, set_.alias("_set"), F.col(value).alias("_value")).groupBy(key, "_set").agg(F.count("*").alias("_n"), F.min("_value").alias("_value")).where("_n = 1")
    return rows.withColumn("_set", set_).join(lone.drop("_n"), [key, "_set"], "left").withColumn(value, F.coalesce(value, "_value")).select(*rows.columns)


def already_met(new: DataFrame, rows: DataFrame, event: str, people: str, id_: str) -> DataFrame:
    """New matches whose people do not all meet on that card already."""
    met = new.select(event, id_, F.col(people).alias("_new")).join(rows.select(event, F.col(people).alias("_old")), event).where(F.size(F.array_except("_new", "_old")) == 0)
    return new.join(met.select(id_).distinct(), id_, "left_anti")


def plan_and_apply(rows: DataFrame, patches: DataFrame, id_: str, field: str, dry_run: bool) -> DataFrame:
    """The plan (id, old, new) of patches (id, value) that would change something, or the rows after it."""
    p = patches.select(id_, F.col("value").alias("_v"))
    joined = rows.join(p, id_, "left")
    changes = F.col("_v").isNotNull() & ~F.col(field).eqNullSafe(F.col("_v"))
    if dry_run:
        return joined.where(changes).select(id_, F.col(field).alias("old"), F.col("_v").alias("new"))
    return joined.withColumn(field, F.when(changes, F.col("_v")).otherwise(F.col(field))).select(*rows.columns)


def with_content(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows that hold something besides their key; empty strings and empty arrays are null."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    blank = lambda f: F.when(F.size(f) > 0, F.col(f)) if types[f].startswith("array") else F.when(F.trim(F.col(f).cast("string")) != "", F.col(f))
    out = rows.select(key, *(blank(f).alias(f) for f in fields))
    return out.where(F.coalesce(*(F.col(f).cast("string") for f in fields)).isNotNull())


def field_coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, n: in how many rows a field is there."""
    one = rows.agg(*(F.count(f).alias(f) for f in fields))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields))).alias("_r")).select("_r.*")
