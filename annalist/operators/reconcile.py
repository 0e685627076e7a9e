"""Merging records of several sources: upserts, stable ids, votes, patches and greedy pairing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_key, ratio
from .lineage import cut


def fill_nulls(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with their nulls filled from new ones, and the new rows; an old value is never overwritten."""
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in values))
    n = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in values))
    return o.join(n, keys, "full").select(*keys, *(F.coalesce(f"_o_{c}", f"_n_{c}").alias(c) for c in values))


def merge(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """A full outer merge with a policy per column: keep (old first), overwrite (new first) or replace (new, even null, where there is a new row)."""
    o = old.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in policy), F.lit(True).alias("_old"))
    n = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in policy), F.lit(True).alias("_new"))
    pick = {"keep": lambda c: F.coalesce(f"_o_{c}", f"_n_{c}"), "overwrite": lambda c: F.coalesce(f"_n_{c}", f"_o_{c}"), "replace": lambda c: F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))}
    return o.join(n, keys, "full").select(*keys, *(pick[p](c).alias(c) for c, p in policy.items()))


def conflicts(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, field, old, new: where both sides have a value and they differ."""
    both = old.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in columns)).join(new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in columns)), keys)
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"_o_{c}").cast("string").alias("old"), F.col(f"_n_{c}").cast("string").alias("new")) for c in columns))
    return both.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*").where("old IS NOT NULL AND new IS NOT NULL AND old <> new")


def stable_ids(current: DataFrame, prior: DataFrame, keys: list[str], top: DataFrame, id_: str = "id") -> DataFrame:
    """keys and id: the prior id of a business key, else a new one above every id ever used (column ``top``), by key order.

    New keys are numbered by range partitions with offsets, so that no single task orders all of them.
    """
    joined = current.select(*keys).distinct().join(prior.groupBy(*keys).agg(F.min(id_).alias(id_)), keys, "left")
    known, fresh = joined.where(F.col(id_).isNotNull()), joined.where(F.col(id_).isNull()).drop(id_)
    return known.unionByName(dense_rank(fresh, keys, "_k").crossJoin(F.broadcast(top)).withColumn(id_, F.col("top") + F.col("_k")).select(*keys, id_))


def dense_rank(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers rows 1, 2, ... in a total order, by sorted range partitions and the sizes of those before.

    The partitions are written once, since both uses must see the same range bounds.
    """
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_id", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.withColumn("_part", part).join(before, "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_part", "_size", "_before")


def get_or_create(names: DataFrame, table: DataFrame, name: str, id_: str) -> DataFrame:
    """The table and a row for each new name, with ids above the largest, by name."""
    fresh = names.select(name).distinct().join(table, name, "left_anti")
    top = table.agg(F.coalesce(F.max(id_), F.lit(0)).alias("top"))
    return table.select(id_, name).unionByName(dense_rank(fresh, [name], "_k").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("_k")).alias(id_), name))


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first in the given order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def append_new(base: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The base, and the new rows whose key (nulls equal) it does not have; within the new ones the first in the given order."""
    same = [base[k].eqNullSafe(new[k]) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return base.unionByName(first_wins(new.join(base, cond, "left_anti"), keys, order), allowMissingColumns=True)


def replace_range(base: DataFrame, new: DataFrame, in_range: Column) -> DataFrame:
    """Drops a range of the base and puts the new rows in."""
    return base.where(~F.coalesce(in_range, F.lit(False))).unionByName(new, allowMissingColumns=True)


def confirmed(votes: DataFrame, keys: list[str], source: str, least: int = 2) -> DataFrame:
    """Keys that ``least`` different sources name, with the number of sources."""
    return votes.groupBy(*keys).agg(F.countDistinct(source).alias("n")).where(F.col("n") >= least)


def verdict(ours: Column, his: Column, third: Column, kind: Column, complete: Column) -> Column:
    """What three records of one match tell: keep, fix, add, split or review.

    ours, his, third: arrays of people (null: the source has no row); kind: the class of the difference.
    """
    key = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), "|")
    agree = key(his) == key(third)
    backs_us = key(ours) == key(third)
    return F.when(ours.isNull() & agree, "add").when(third.isNull(), "review").when(backs_us, "keep").when(agree & (kind == "result"), "fix").when(agree & complete, "fix").when(F.size(F.array_union(his, third)) == F.size(ours), "split").otherwise("review")


def patch(rows: DataFrame, patches: DataFrame, id_: str, guard: str, fields: list[str]) -> DataFrame:
    """Sets fields of the rows that patches (id, guard_text, field, value) name; the guard text must still be there.

    A patch whose row is absent or reads differently fails the job.
    """
    keyed = patches.select(F.col(id_), F.col("guard_text"), "field", "value")
    stale = keyed.join(rows.select(id_, F.col(guard).alias("_g")), id_, "left").where(F.col("_g").isNull() | ~F.col("_g").startswith(F.col("guard_text")))
    wide = keyed.groupBy(id_).pivot("field", fields).agg(F.first("value")).select(id_, *(F.col(f).alias(f"_p_{f}") for f in fields))
    bad = stale.agg(F.count("*").alias("_bad"))
    checked = rows.crossJoin(F.broadcast(bad)).withColumn(id_, F.when(F.col("_bad") == 0, F.col(id_)).otherwise(F.raise_error(F.lit("a patch does not fit its row"))))
    types = {f.name: f.dataType for f in rows.schema}
    return checked.drop("_bad").join(wide, id_, "left").select(*(F.coalesce(F.col(f"_p_{c}").cast(types[c]), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns))


def rename_people(events: DataFrame, column: str, bad: str, good: str) -> DataFrame:
    """A literal rename in an array of names and, as whole words, in raw_description where there is one."""
    out = events.withColumn(column, F.transform(column, lambda n: F.when(n == bad, good).otherwise(n)))
    return out.withColumn("raw_description", F.regexp_replace("raw_description", rf"(?<!\w){bad}(?!\w)", good)) if "raw_description" in events.columns else out


def translate(rows: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Values through a table (value, meaning); an unknown value fails the job."""
    out = rows.join(table.withColumnRenamed("value", column), column, "left")
    return out.withColumn(column, F.when(F.col(column).isNull() | F.col("meaning").isNotNull(), F.col("meaning")).otherwise(F.raise_error(F.concat(F.lit("no meaning for "), F.col(column))))).drop("meaning").select(*rows.columns)


def greedy_pairs(ours: list[list[str]], theirs: list[list[str]], least: float = 0.5, loose: float = 0.34) -> list[tuple[int, int, float]]:
    """Pairs of our matches and theirs by shared people: best score first, each used once; a second, looser pass for the rest."""
    keys = lambda side: [{name_key(p) for p in m} for m in side]
    a, b = keys(ours), keys(theirs)
    score = lambda x, y: len(x & y) / max(1, max(len(x), len(y)))
    out, used_a, used_b = [], set(), set()
    for gate in (least, loose):
        ranked = sorted(((score(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), key=lambda t: (-t[0], t[1], t[2]))
        for s, i, j in ranked:
            if s >= gate and i not in used_a and j not in used_b:
                out.append((i, j, s))
                used_a.add(i)
                used_b.add(j)
    return sorted(out)


def compare_cards(cards: DataFrame) -> DataFrame:
    """event_id, class, ours, theirs: differences of two records of each event.

    cards: event_id, ours and theirs: array<struct<sides array<array<string>>, winner int>> in card order,
    winner the number of the winning side (null: none).
    """

    def classes(mine: list, other: list) -> Iterator[tuple[str, int | None, int | None]]:
        flat = lambda m: [p for s in m["sides"] for p in s]
        pairs = greedy_pairs([flat(m) for m in mine], [flat(m) for m in other])
        for i, j, score in pairs:
            x, y = mine[i], other[j]
            left, right = {name_key(p) for p in flat(x)}, {name_key(p) for p in flat(y)}
            if left != right:
                missing, extra = right - left, left - right
                near = missing and extra and all(any(ratio(m, e) >= 0.7 for e in extra) for m in missing)
                yield "spelling" if near else "different_people" if missing and extra else "missing_person" if missing else "extra_person", i, j
            team = lambda m: frozenset(frozenset(map(name_key, s)) for s in m["sides"])
            if left == right and team(x) != team(y):
                yield "sides", i, j
            won = lambda m: None if m["winner"] is None else frozenset(map(name_key, m["sides"][int(m["winner"])]))
            if won(x) != won(y):
                yield "winner" if won(x) and won(y) else "no_winner", i, j
        for i in set(range(len(mine))) - {p[0] for p in pairs}:
            yield "only_ours", i, None
        for j in set(range(len(other))) - {p[1] for p in pairs}:
            yield "only_theirs", None, j
        order = [j for _, j, _ in pairs]
        if order != sorted(order):
            yield "order", None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (c.to_pylist() for c in batch.columns)
            rows = [(e, *c) for e, a, b in zip(*columns, strict=True) for c in classes(a or [], b or [])]
            if rows:
                types = [pa.int64(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["event_id", "class", "ours", "theirs"])

    return cards.select(F.col("event_id").cast("long"), "ours", "theirs").mapInArrow(run, "event_id long, class string, ours int, theirs int")


def without_ruled(rows: DataFrame, rulings: DataFrame) -> DataFrame:
    """Rows (class, event, match, line) without those a ruling (class, event, match, prefix) settles."""
    r = rulings.select(*(F.col(c).alias(f"_{c}") for c in ("class", "event", "match", "prefix")))
    return rows.join(r, (F.col("class") == F.col("_class")) & (F.col("event") == F.col("_event")) & F.col("match").eqNullSafe(F.col("_match")) & F.col("line").startswith(F.col("_prefix")), "left_anti")


def free_weeks(events: DataFrame, official: str = "cagematch", share: float = 0.6) -> DataFrame:
    """event_id, air_date: collisions on a date of one show settled.

    events: event_id, show_type, air_date, episode, source, matches array<array<string>> (the people of each).
    On a shared date a record of another source is dropped where the ``official`` source has a twin: a card
    that shares matches with it, ``share`` of the smaller one's and one at least.  What is left is moved, by
    episode, to the next week without a show.  Sequential state is one show's dates.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["air_date", "episode", "event_id"], na_position="last", kind="stable").to_dict("records")
        for r in rows:
            r["met"] = {frozenset(map(name_key, m)) for m in (r["matches"] if r["matches"] is not None else ())}
        best = [r for r in rows if r["source"] == official]

        def twin(r: dict) -> bool:
            near = (b["met"] for b in best if b["air_date"] == r["air_date"])
            return r["source"] != official and any(len(r["met"] & m) >= max(1, int(share * min(len(r["met"]), len(m)))) for m in near)

        kept = [r for r in rows if not twin(r)]
        taken, used = {r["air_date"] for r in kept}, set()
        for r in kept:
            day = r["air_date"]
            while day in used or day != r["air_date"] and day in taken:
                day = day + pd.Timedelta(days=7)
            used.add(day)
            r["air_date"] = day
        return pd.DataFrame([(r["event_id"], r["air_date"]) for r in kept], columns=["event_id", "air_date"])

    return events.groupBy("show_type").applyInPandas(run, "event_id long, air_date date")


def changed(before: DataFrame, after: DataFrame, allowed: list[str]) -> DataFrame:
    """Rows that differ in other than the allowed columns: empty if a rebuild is faithful."""
    fixed = [c for c in before.columns if c not in allowed]
    a, b = before.select(*fixed), after.select(*fixed)
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))
