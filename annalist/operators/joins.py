"""Joins that records of several sources need: validity ranges, near dates, unique and tiered candidates.

Range conditions get an equi-key (a bucket of days) where both sides may be large, so that no join here
is a nested loop over two growing inputs.  Small dimension tables are left to the optimizer's own size
check for broadcasting.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def validity_join(rows: DataFrame, eras: DataFrame, day: Column, lo: str = "lo", hi: str = "hi", on: Column | None = None, how: str = "inner") -> DataFrame:
    """Every era (inclusive bounds, null is open) that holds the row's day: none, one or several rows."""
    inside = (F.col(lo).isNull() | (day >= F.col(lo))) & (F.col(hi).isNull() | (day <= F.col(hi)))
    return rows.join(eras, inside if on is None else on & inside, how)


def within_days(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, days: int) -> DataFrame:
    """Pairs of one key at most so many days apart, by an equi-join on day buckets.

    left_day and right_day are date columns with different names; the result has all columns of both.
    """
    width = max(1, days)
    bucket = lambda c: F.floor(F.unix_date(c) / width)
    near = left.withColumn("_bucket", F.explode(F.array(*(bucket(F.col(left_day)) + i for i in (-1, 0, 1)))))
    other = right.withColumn("_bucket", bucket(F.col(right_day)))
    return near.join(other, [*keys, "_bucket"]).where(F.abs(F.datediff(left_day, right_day)) <= days).drop("_bucket")


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """Pairs of one key with left_ts < right_ts <= left_ts + seconds, by time buckets of that width."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = seconds * 1_000_000
    a = left.withColumn("_b", F.explode(F.array(F.floor(micros(left_ts) / width), F.floor(micros(left_ts) / width) + 1)))
    b = right.withColumn("_b", F.floor(micros(right_ts) / width))
    gap = micros(right_ts) - micros(left_ts)
    return a.join(b, [*keys, "_b"]).where((gap > 0) & (gap <= width)).drop("_b")


def stab_join(rows: DataFrame, intervals: DataFrame, keys: list[str], day: str, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals with start < day <= end (null end: still open) of the same keys.

    The keys deal the rows; a key's intervals are few by nature (reigns of a belt), its rows may be many.
    """
    return rows.join(intervals, keys).where((F.col(start) < F.col(day)) & (F.col(end).isNull() | (F.col(day) <= F.col(end))))


def nearest(rows: DataFrame, entries: DataFrame, keys: list[str], day: str, entry_day: str, value: str, row_id: str, most_days: int | None = None) -> DataFrame:
    """The entry nearest in days to each row (ties: the earlier), by one window over the union of both.

    Returns row_id, nearest (the value, null if there is none) and days.
    """
    a = rows.select(*keys, F.col(day).alias("_day"), F.lit(1).alias("_kind"), F.col(row_id).alias("_id"), F.lit(None).cast(entries.schema[value].dataType).alias("_value"))
    b = entries.select(*keys, F.col(entry_day).alias("_day"), F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema[row_id].dataType).alias("_id"), F.col(value).alias("_value"))
    both = a.unionByName(b)
    entry = F.when(F.col("_kind") == 0, F.struct("_day", "_value"))
    w = Window.partitionBy(*keys)
    before = F.last(entry, True).over(w.orderBy("_day", "_kind", "_value").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(entry, True).over(w.orderBy(F.desc("_day"), "_kind", F.desc("_value")).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_p", before).withColumn("_n", after).where("_kind = 1")
    dp, dn = F.datediff("_day", "_p._day"), F.datediff("_n._day", "_day")
    days = F.when(dn.isNull() | (dp <= dn), dp).otherwise(dn)
    value_ = F.when(dn.isNull() | (dp <= dn), F.col("_p._value")).otherwise(F.col("_n._value"))
    out = found.select(F.col("_id").alias(row_id), value_.alias("nearest"), days.alias("days"))
    return out if most_days is None else out.withColumns({"nearest": F.when(F.col("days") <= most_days, F.col("nearest")), "days": F.when(F.col("days") <= most_days, F.col("days"))})


def as_of(rows: DataFrame, entries: DataFrame, keys: list[str], day: str, entry_day: str, value: str, row_id: str) -> DataFrame:
    """The newest entry on or before each row's day: row_id, as_of."""
    a = rows.select(*keys, F.col(day).alias("_day"), F.lit(1).alias("_kind"), F.col(row_id).alias("_id"), F.lit(None).cast(entries.schema[value].dataType).alias("_value"))
    b = entries.select(*keys, F.col(entry_day).alias("_day"), F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema[row_id].dataType).alias("_id"), F.col(value).alias("_value"))
    w = Window.partitionBy(*keys).orderBy("_day", "_kind", "_value").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("_kind") == 0, F.struct("_value")), True).over(w)
    return a.unionByName(b).withColumn("_held", held).where("_kind = 1").select(F.col("_id").alias(row_id), F.col("_held._value").alias("as_of"))


def unique_only(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no other row has."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def unique_candidate(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join that accepts a right row only where it is the only one of its key.

    The right side is thinned by a partial aggregate before it moves.
    """
    others = [c for c in right.columns if c not in keys]
    lone = right.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in others)).where("_n = 1").drop("_n")
    return left.join(lone, keys, how)


def tiered(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[tuple]) -> DataFrame:
    """left_id, right_id, rule: the first rule that joins a row with its only candidate, each row of either side used once.

    A rule is a name, equal keys of both sides (null joins nothing) and, for a range of days, (left day, right
    day, most days).  A pair is accepted where neither row has another candidate among the rows still free;
    what a rule leaves goes on to the next; lineage is cut after each.
    """
    out, a, b = None, left, right
    for name, lk, rk, *days in tiers:
        keys = [f"_k{i}" for i in range(len(lk))]
        ld, rd, most = days[0] if days else (None, None, None)
        side = lambda df, cols, id_, day, keys=keys: reduce(lambda d, c: d.where(F.col(c).isNotNull()), keys, df.select(id_, *(c.alias(k) for c, k in zip(cols, keys, strict=True)), *([day] if day is not None else [])))
        x, y = side(a, lk, left_id, None if ld is None else ld.alias("_ld")), side(b, rk, right_id, None if rd is None else rd.alias("_rd"))
        pairs = x.join(y, keys) if most is None else within_days(x, y, keys, "_ld", "_rd", most)
        counted = pairs.select(left_id, right_id).withColumn("_a", F.count("*").over(Window.partitionBy(left_id))).withColumn("_b", F.count("*").over(Window.partitionBy(right_id)))
        got = cut(counted.where("_a = 1 AND _b = 1").select(left_id, right_id, F.lit(name).alias("rule")))
        out = got if out is None else out.unionByName(got)
        a, b = a.join(got.select(left_id), left_id, "left_anti"), b.join(got.select(right_id), right_id, "left_anti")
    return out


def offset_probe(rows: DataFrame, entries: DataFrame, keys: list[str], day: str, entry_day: str, value: str, row_id: str, offsets: tuple = (0, 1, -1, 2, -2, 3, -3)) -> DataFrame:
    """The entry on the row's day, else one day later, one earlier, and so on: row_id, value, offset."""
    tries = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(o).alias("offset")) for i, o in enumerate(offsets)))
    probe = rows.select(*keys, row_id, day).withColumn("_t", F.explode(tries)).withColumn(entry_day, F.date_add(day, F.col("_t.offset")))
    hits = probe.join(entries.select(*keys, entry_day, value), [*keys, entry_day])
    return hits.groupBy(row_id).agg(F.min(F.struct("_t.rank", "_t.offset", value)).alias("_h")).select(row_id, F.col(f"_h.{value}").alias(value), F.col("_h.offset").alias("offset"))


def set_key(parts: Column, separator: str = "|") -> Column:
    """A key that does not depend on the order of an array's elements."""
    return F.array_join(F.array_sort(parts), separator)


def sides_key(sides: Column, part: str = "+", side: str = "|") -> Column:
    """A key of arrays of people that depends neither on the order of sides nor of people."""
    return set_key(F.transform(sides, lambda s: set_key(s, part)), side)


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, left_set: str, right_set: str, least: int = 1) -> DataFrame:
    """The candidate with the largest set overlap; none if the best is below ``least`` or tied."""
    scored = left.join(right, keys).withColumn("_s", F.size(F.array_intersect(left_set, right_set))).where(F.col("_s") >= least)
    w = Window.partitionBy(left_id).orderBy(F.desc("_s"))
    ranked = scored.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead("_s").over(w))
    return ranked.where("_k = 1 AND (_next IS NULL OR _next < _s)").select(left_id, right_id, F.col("_s").alias("overlap"))


def overlap_ratio(a: Column, b: Column, of_larger: bool) -> Column:
    """Shared people as a share of the larger or the smaller set."""
    size = F.greatest(F.size(a), F.size(b)) if of_larger else F.least(F.size(a), F.size(b))
    return F.when(size > 0, F.size(F.array_intersect(a, b)) / size).otherwise(F.lit(0.0))


def token_subset(left: DataFrame, right: DataFrame, keys: list[str], left_tokens: str, right_tokens: str, left_id: str, right_id: str) -> DataFrame:
    """Names whose words are a subset one of the other, within a key; ambiguous ones are left out.

    Rows are compared as classes, the different word sets of a key.  Two classes meet by a word, and not by every
    word that they share: of the smaller set only the word is dealt that the fewest sets of the other side have.
    Copies of a name are never joined one by one: the least and the greatest right id of a class tell whether
    a left row has a single candidate.  A null key or word array joins nothing.
    """
    cols = [*keys, "_set"]
    side = lambda df, tokens, id_: df.select(*keys, F.array_sort(F.array_distinct(tokens)).alias("_set"), F.struct(F.col(id_).alias("id")).alias("_id")).where(reduce(lambda c, k: c & F.col(k).isNotNull(), keys, F.col("_set").isNotNull()))
    ours = side(left, left_tokens, left_id)
    a, b = ours.select(*cols).distinct(), side(right, right_tokens, right_id).groupBy(*cols).agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"))
    held = _contained(a, b, keys).unionByName(_contained(b, a, keys)).groupBy(*cols).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    found = ours.join(held, cols).groupBy("_id").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return found.where("_lo = _hi").select(F.col("_id.id").alias(left_id), F.col("_lo.id").alias(right_id))


def _contained(small: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of classes (keys and _set, on one side also _lo and _hi) whose first set lies in the second and is not empty.

    Returns the keys, the _set of the side without _lo and _hi, and _lo and _hi of the other.
    """
    words = lambda df: df.select("*", F.explode("_set").alias("_w"))
    meet = reduce(lambda c, n: c & F.col(f"s.{n}").eqNullSafe(F.col(f"l.{n}")), [*keys, "_w"], F.lit(True))
    dealt = words(large)
    known = dealt.groupBy(*keys, "_w").agg(F.count("*").alias("_n"))
    counted = words(small).alias("s").join(known.alias("l"), meet).select(*(F.col(f"s.{c}").alias(c) for c in small.columns), F.struct("l._n", "s._w").alias("_r"))
    rarest = counted.groupBy(*small.columns).agg(F.min("_r").alias("_r")).select(*small.columns, F.col("_r._w").alias("_w"))
    pairs = rarest.alias("s").join(dealt.alias("l"), meet).where(F.size(F.array_except("s._set", "l._set")) == 0)
    own, other = ("s", "l") if "_lo" in large.columns else ("l", "s")
    return pairs.select(*(F.col(f"s.{k}").alias(k) for k in keys), F.col(f"{own}._set").alias("_set"), F.col(f"{other}._lo").alias("_lo"), F.col(f"{other}._hi").alias("_hi"))


def two_hops(rows: DataFrame, name: str, aliases: DataFrame, out: str = "canonical") -> DataFrame:
    """An alias table (alias, target) applied once, and once more to what came out."""
    first = aliases.select(F.col("alias").alias(name), F.col("target").alias("_1"))
    second = aliases.select(F.col("alias").alias("_1"), F.col("target").alias("_2"))
    return rows.join(first, name, "left").join(second, "_1", "left").withColumn(out, F.coalesce("_2", "_1", name)).drop("_1", "_2")


def coalesce_join(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value by the first key that finds it (each key unique on the right)."""
    out = left
    for i, k in enumerate(keys):
        side = right.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(side, k, "left")
    return out.withColumn(value, reduce(lambda a, b: F.coalesce(a, b), [F.col(f"_v{i}") for i in range(len(keys))])).drop(*(f"_v{i}" for i in range(len(keys))))


def anti_both(left: DataFrame, right: DataFrame, keys: list[str], left_name: str, right_name: str, side: str = "side") -> DataFrame:
    """Keys that only one side has, with the side's name."""
    a = left.select(*keys).join(right.select(*keys), keys, "left_anti").withColumn(side, F.lit(left_name))
    b = right.select(*keys).join(left.select(*keys), keys, "left_anti").withColumn(side, F.lit(right_name))
    return a.unionByName(b)


def covering(events: DataFrame, spans: DataFrame, event_id: str, span_id: str) -> DataFrame:
    """event_id, span_id: spans of months (start, end as YYYY-MM) that hold an event's air_date.

    A span is dealt to each of its months, so the join is by month.
    """
    first = lambda c: F.to_date(F.concat(F.col(c), F.lit("-01")))
    months = spans.withColumn("_m", F.explode(F.sequence(first("start"), first("end"), F.expr("INTERVAL 1 MONTH"))))
    return events.withColumn("_m", F.trunc("air_date", "MM")).join(months.select(span_id, "_m"), "_m").select(event_id, span_id)


def first_family(rows: DataFrame, ranges: DataFrame, row_id: str, day: str, value: str) -> DataFrame:
    """row_id, value: of the ranges (family, priority, lo, hi, value) of a row's family that hold its day, the first by priority."""
    hit = rows.join(ranges, "family").where((F.col("lo").isNull() | (F.col(day) >= F.col("lo"))) & (F.col("hi").isNull() | (F.col(day) <= F.col("hi"))))
    return hit.groupBy(row_id).agg(F.min(F.struct("priority", value)).alias("_v")).select(row_id, F.col(f"_v.{value}").alias(value))
