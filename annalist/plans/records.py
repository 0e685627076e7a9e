"""More of the slate: joins with claims, votes, repairs, text and date rules on the supplied tables, and their SQL.

Analogies: an order is a card, its lines are matches and suppliers people; events tell who (event_type) holds what (user_id) when.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import cards, entity, gates, histories, joins, reconcile, repairs, rollup, timeline
from .slate import query, read


def _orders(spark, d):
    return read(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))


def _lines(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_partkey", "l_quantity")


def _values(spark, columns: str, rows: str):
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


# joins


@query("""WITH a AS (SELECT c_custkey, c_nationkey n, CAST(floor(c_acctbal/500) AS BIGINT) b, CAST(floor(c_acctbal/2000) AS BIGINT) w FROM customer),
 s AS (SELECT s_suppkey, s_nationkey n, CAST(floor(s_acctbal/500) AS BIGINT) b, CAST(floor(s_acctbal/2000) AS BIGINT) w FROM supplier),
 p1 AS (SELECT c_custkey, s_suppkey, count(*) OVER (PARTITION BY c_custkey) x, count(*) OVER (PARTITION BY s_suppkey) y FROM a JOIN s USING (n, b)),
 g1 AS (SELECT c_custkey, s_suppkey, 'balance' AS rule FROM p1 WHERE x=1 AND y=1),
 p2 AS (SELECT c_custkey, s_suppkey, count(*) OVER (PARTITION BY c_custkey) x, count(*) OVER (PARTITION BY s_suppkey) y FROM a JOIN s USING (n, w)
        WHERE c_custkey NOT IN (SELECT c_custkey FROM g1) AND s_suppkey NOT IN (SELECT s_suppkey FROM g1))
SELECT * FROM g1 UNION ALL SELECT c_custkey, s_suppkey, 'wide' FROM p2 WHERE x=1 AND y=1""")
def q41_tiered_claims(spark, d):
    near = lambda c, w: F.floor(F.col(c) / w)
    tiers = [(name, [F.col("c_nationkey"), near("c_acctbal", w)], [F.col("s_nationkey"), near("s_acctbal", w)]) for name, w in (("balance", 500), ("wide", 2000))]
    return joins.tiered(read(spark, d, "customer"), read(spark, d, "supplier"), "c_custkey", "s_suppkey", tiers)


@query("""WITH a AS (SELECT o_orderkey, o_custkey k, CAST(o_orderdate AS DATE) d FROM orders WHERE o_orderstatus='F'), b AS (SELECT o_orderkey AS other, o_custkey k, CAST(o_orderdate AS DATE) d FROM orders WHERE o_orderstatus='P'),
 p AS (SELECT o_orderkey, other, count(*) OVER (PARTITION BY o_orderkey) x, count(*) OVER (PARTITION BY other) y FROM a JOIN b USING (k) WHERE abs(date_diff('day', a.d, b.d))<=90)
SELECT o_orderkey, other, 'near' AS rule FROM p WHERE x=1 AND y=1""")
def q42_tier_by_days(spark, d):
    o = _orders(spark, d)
    done, open_ = o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'").withColumnRenamed("o_orderkey", "other")
    return joins.tiered(done, open_, "o_orderkey", "other", [("near", [F.col("o_custkey")], [F.col("o_custkey")], (F.col("day"), F.col("day"), 90))])


@query("""WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) d FROM events), p AS (SELECT user_id, CAST(ts AS DATE) d, min(event_id) v FROM events WHERE event_type='purchase' GROUP BY 1,2),
 o(rank, off) AS (VALUES (0,0),(1,1),(2,-1),(3,2),(4,-2),(5,3),(6,-3))
SELECT e.event_id, p.v AS found, CAST(off AS BIGINT) AS offset_days FROM e CROSS JOIN o JOIN p ON p.user_id=e.user_id AND p.d = e.d + CAST(off AS INTEGER)
QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY rank)=1""")
def q43_offset_probe(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("day"), "event_type")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", F.col("day").alias("entry_day")).agg(F.min("event_id").alias("found"))
    return joins.offset_probe(e, bought, ["user_id"], "day", "entry_day", "found", "event_id").select("event_id", "found", F.col("offset").cast("long").alias("offset_days"))


@query("""WITH f AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) i FROM f), r AS (SELECT user_id, i, min(event_type) holder, min(ts) s FROM s GROUP BY 1,2),
 iv AS (SELECT user_id, holder, s, lead(s) OVER (PARTITION BY user_id ORDER BY i) e FROM r)
SELECT e.event_id, iv.holder FROM events e JOIN iv ON e.user_id=iv.user_id AND iv.s < e.ts AND (iv.e IS NULL OR e.ts <= iv.e)""")
def q44_holder_on_a_day(spark, d):
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    iv = timeline.reigns(e, ["user_id"], ["ts", "event_id"], "event_type", "ts").select("user_id", "holder", F.col("start_ts").alias("start"), F.col("end_ts").alias("end"))
    return joins.stab_join(e, iv, ["user_id"], "ts").select("event_id", "holder")


@query("""WITH s AS (SELECT o_orderpriority AS span, strftime(min(o_orderdate),'%Y-%m') a, strftime(max(o_orderdate),'%Y-%m') b FROM orders WHERE o_orderstatus='P' GROUP BY 1)
SELECT o_orderkey, span FROM orders JOIN s ON strftime(o_orderdate,'%Y-%m') BETWEEN a AND b""")
def q45_month_spans(spark, d):
    o = _orders(spark, d)
    month = lambda f: F.date_format(f("day"), "yyyy-MM")
    spans = o.where("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("span")).agg(month(F.min).alias("start"), month(F.max).alias("end"))
    return joins.covering(o.select("o_orderkey", F.col("day").alias("air_date")), spans, "o_orderkey", "span")


@query("""WITH r(family,priority,lo,hi,logo) AS (VALUES ('O',2,NULL::DATE,NULL::DATE,'any'),('O',1,DATE '1997-01-01',DATE '1997-12-31','year'),('F',1,DATE '1996-01-01',NULL::DATE,'late'))
SELECT o_orderkey, logo FROM orders JOIN r ON o_orderstatus=family AND (lo IS NULL OR CAST(o_orderdate AS DATE)>=lo) AND (hi IS NULL OR CAST(o_orderdate AS DATE)<=hi)
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY priority)=1""")
def q46_logo_by_range(spark, d):
    r = _values(spark, "family, priority, lo, hi, logo", "('O', 2, CAST(NULL AS DATE), CAST(NULL AS DATE), 'any'), ('O', 1, DATE '1997-01-01', DATE '1997-12-31', 'year'), ('F', 1, DATE '1996-01-01', CAST(NULL AS DATE), 'late')")
    return joins.first_family(_orders(spark, d).withColumn("family", F.col("o_orderstatus")), r, "o_orderkey", "day", "logo")


@query("""WITH a(alias,target) AS (VALUES ('BUILDING','HOUSEHOLD'),('HOUSEHOLD','HOME'),('MACHINERY','TOOLS'))
SELECT c_custkey, coalesce(a2.target, a1.target, c_mktsegment) AS canonical FROM customer LEFT JOIN a a1 ON c_mktsegment=a1.alias LEFT JOIN a a2 ON a1.target=a2.alias""")
def q47_alias_chain(spark, d):
    a = _values(spark, "alias, target", "('BUILDING', 'HOUSEHOLD'), ('HOUSEHOLD', 'HOME'), ('MACHINERY', 'TOOLS')")
    return joins.two_hops(read(spark, d, "customer"), "c_mktsegment", a).select("c_custkey", "canonical")


@query("""WITH t AS (SELECT CAST(l_shipdate AS DATE) AS ship, min(l_orderkey) v FROM lineitem GROUP BY 1), q AS (SELECT CAST(o_orderdate AS DATE) AS ord, min(o_orderkey) v FROM orders GROUP BY 1)
SELECT o_orderkey, coalesce(t.v, 0) AS found FROM orders LEFT JOIN t ON CAST(o_orderdate AS DATE)=t.ship""")
def q48_first_key_that_finds(spark, d):
    o = _orders(spark, d).select("o_orderkey", F.col("day").alias("ship"))
    other = read(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("ship"), F.col("l_orderkey").alias("found"))
    return joins.coalesce_join(o, other, ["ship"], "found").select("o_orderkey", F.coalesce("found", F.lit(0).cast("long")).alias("found"))


@query("""WITH a AS (SELECT p_partkey, p_type k, string_split(p_name,' ') t FROM part WHERE p_size<=10), b AS (SELECT p_partkey AS other, p_type k, string_split(p_name,' ') u FROM part WHERE p_size>45),
 m AS (SELECT DISTINCT p_partkey, other FROM a JOIN b USING (k) WHERE (len(list_filter(t, lambda x: NOT list_contains(u, x)))=0 OR len(list_filter(u, lambda x: NOT list_contains(t, x)))=0) AND len(list_intersect(t,u))>0)
SELECT p_partkey, other FROM m QUALIFY count(*) OVER (PARTITION BY p_partkey)=1""")
def q49_words_within_words(spark, d):
    p = read(spark, d, "part").withColumn("words", F.split("p_name", " "))
    left, right = p.where("p_size <= 10").select("p_partkey", "p_type", F.col("words").alias("a")), p.where("p_size > 45").select(F.col("p_partkey").alias("other"), "p_type", F.col("words").alias("b"))
    return joins.token_subset(left, right, ["p_type"], "a", "b", "p_partkey", "other")


@query("""WITH s AS (SELECT l_orderkey k, list(DISTINCT l_suppkey) p FROM lineitem GROUP BY 1), o AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) nxt FROM orders)
SELECT o_orderkey, nxt, len(list_intersect(a.p,b.p))/greatest(len(a.p),len(b.p)) AS of_larger, len(list_intersect(a.p,b.p))/least(len(a.p),len(b.p)) AS of_smaller FROM o JOIN s a ON a.k=o_orderkey JOIN s b ON b.k=nxt""")
def q50_people_overlap(spark, d):
    from pyspark.sql import Window

    sets = _lines(spark, d).groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("p"))
    o = read(spark, d, "orders").select("o_orderkey", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("nxt"))
    both = o.join(sets.toDF("o_orderkey", "a"), "o_orderkey").join(sets.toDF("nxt", "b"), "nxt")
    return both.select("o_orderkey", "nxt", joins.overlap_ratio(F.col("a"), F.col("b"), True).alias("of_larger"), joins.overlap_ratio(F.col("a"), F.col("b"), False).alias("of_smaller"))


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderstatus)=1""")
def q51_ambiguous_out(spark, d):
    return joins.unique_only(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"])


# statistics


_OUTCOMES = """o AS (SELECT l_suppkey, CASE WHEN bool_or(l_returnflag='N' AND l_linenumber=1) OVER w THEN 'NC' WHEN bool_or(l_returnflag='N' AND l_linenumber=2) OVER w THEN 'D' WHEN l_returnflag='A' THEN 'W' WHEN l_returnflag='R' THEN 'L' ELSE 'NC' END r
 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))"""


def _sides(spark, d):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    return _lines(spark, d).select(F.col("l_orderkey").alias("match_id"), line.alias("team_number"), F.when(flag != "N", flag == "A").alias("was_winner"), F.when((flag == "N") & (line == 1), "no_contest").when((flag == "N") & (line == 2), "draw").alias("match_outcome"), F.col("l_suppkey").alias("name"))


@query(f"""WITH {_OUTCOMES} SELECT l_suppkey AS name, count(*) AS n, count(*) FILTER (r='W') AS w, count(*) FILTER (r='L') AS l, count(*) FILTER (r='D') AS d, count(*) FILTER (r='NC') AS nc FROM o GROUP BY 1""")
def q52_outcomes(spark, d):
    return rollup.match_outcomes(_sides(spark, d)).groupBy("name").agg(F.count("*").alias("n"), *(F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("W", "L", "D", "NC")))


@query(f"""WITH {_OUTCOMES}, x AS (SELECT count(*) n, count(*) FILTER (r='W') + count(*) FILTER (r='L') + count(*) FILTER (r='D') + count(*) FILTER (r='NC') m FROM o GROUP BY l_suppkey) SELECT count(*) AS broken FROM x WHERE n<>m""")
def q53_outcomes_add_up(spark, d):
    return gates.outcome_sums(q52_outcomes(spark, d)).agg(F.count("*").alias("broken"))


@query("""WITH l AS (SELECT l_suppkey s, l_orderkey e, l_linenumber=max(l_linenumber) OVER (PARTITION BY l_orderkey) m FROM lineitem)
SELECT s AS name, count(DISTINCT e) AS events, count(DISTINCT e) FILTER (o_orderpriority='1-URGENT') AS ppvs, count(*) FILTER (m) AS mains FROM l JOIN orders ON e=o_orderkey GROUP BY 1""")
def q54_appearances(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), (F.col("o_orderpriority") == "1-URGENT").alias("is_ppv"))
    m = rollup.main_events(_lines(spark, d).select(F.col("l_orderkey").alias("event_id"), "l_linenumber", F.col("l_suppkey").alias("name")), order="l_linenumber")
    return rollup.appearances(m.join(o, "event_id"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey k, l_linenumber n, l_suppkey p FROM lineitem), t AS (SELECT k, n, count(*) c, min(p) p FROM s GROUP BY 1,2), d AS (SELECT k, min(p) a, max(p) b, count(*) c, max(c) m, list(p ORDER BY n) l FROM t GROUP BY 1 HAVING count(*)=2 AND max(c)=1),
 x AS (SELECT l[1] a, l[2] b FROM d UNION ALL SELECT l[2], l[1] FROM d) SELECT a, b, count(*) AS n FROM x GROUP BY 1,2""")
def q55_rivalries(spark, d):
    return rollup.rivalries(_lines(spark, d).select(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("team_number"), F.col("l_suppkey").alias("name")))


_RUNS = """f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) i FROM f), r AS (SELECT user_id, i, min(event_type) holder, CAST(min(ts) AS DATE) st FROM s GROUP BY 1,2),
 iv AS (SELECT user_id, i, holder, st, lead(st) OVER (PARTITION BY user_id ORDER BY i) e FROM r)"""


def _reigns(spark, d):
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    r = timeline.reigns(e, ["user_id"], ["ts", "event_id"], "event_type", "ts")
    return r.select(F.col("user_id").alias("lineage"), F.col("isl").alias("idx"), F.array("holder").alias("champion_names"), F.col("start_ts").cast("date").alias("start"), F.col("end_ts").cast("date").alias("end"), (F.col("isl") == 1).alias("pre_corpus"))


@query(f"WITH {_RUNS} SELECT holder AS name, user_id AS lineage, count(*) AS wins FROM iv WHERE i>1 GROUP BY 1,2")
def q56_title_wins(spark, d):
    return rollup.title_wins(_reigns(spark, d))


@query(f"""WITH {_RUNS}, x AS (SELECT holder AS name, user_id AS title, st, e, lead(st) OVER (PARTITION BY holder, user_id ORDER BY st, i) n FROM iv)
SELECT name, title, count(*) AS reigns, count(*) FILTER (n < coalesce(e, DATE '9999-12-31')) AS overlapping FROM x GROUP BY 1,2""")
def q57_interval_index(spark, d):
    return timeline.interval_index(_reigns(spark, d), "lineage").groupBy("name", F.col("lineage").alias("title")).agg(F.count("*").alias("reigns"), F.count_if("overlaps").alias("overlapping"))


@query(f"WITH {_RUNS}, x AS (SELECT *, lead(st) OVER (PARTITION BY user_id ORDER BY i) n FROM iv WHERE holder<>'error'), b AS (SELECT * FROM x WHERE (n IS NOT NULL AND e IS NULL) OR e < st OR (n IS NOT NULL AND n <> e)) SELECT user_id AS lineage, count(*) AS problems FROM b GROUP BY 1")
def q58_chain_problems(spark, d):
    some = _reigns(spark, d).where("champion_names[0] <> 'error'")
    return timeline.chain_problems(some, ["lineage"]).groupBy("lineage").agg(F.count("*").alias("problems"))


@query("""WITH c AS (SELECT coalesce(nullif(o_orderpriority,'5-LOW'),'Wikipedia') source FROM orders UNION ALL SELECT coalesce(nullif(trim(regexp_replace(s,'#.*$','')),''),'Wikipedia') FROM (SELECT unnest([source, 'a#1', '#2']) s FROM documents WHERE source IS NOT NULL))
SELECT source, count(*) AS n FROM c GROUP BY 1""")
def q59_source_credits(spark, d):
    o = read(spark, d, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("primary_source"))
    h = read(spark, d, "documents").where("source IS NOT NULL").select(F.array("source", F.lit("a#1"), F.lit("#2")).alias("sources"))
    return rollup.source_credits(o, h)


@query("""WITH c AS (SELECT l_suppkey k, l_linenumber v, count(*) n FROM lineitem GROUP BY 1,2) SELECT k AS l_suppkey, v AS l_linenumber FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, v)=1""")
def q60_modal_offset(spark, d):
    return rollup.modal(_lines(spark, d), ["l_suppkey"], "l_linenumber")


@query("""WITH m AS (SELECT l_orderkey e, l_linenumber o, year(o_orderdate) y FROM lineitem JOIN orders ON l_orderkey=o_orderkey), w AS (SELECT o_orderkey e FROM orders WHERE o_orderpriority='1-URGENT'), v AS (SELECT DISTINCT l_orderkey e, l_linenumber o FROM lineitem WHERE l_returnflag='R')
SELECT y AS "year", count(DISTINCT m.e) AS events, count(DISTINCT w.e) AS with_show, count(*) AS matches, count(v.e) AS with_video FROM m LEFT JOIN w ON m.e=w.e LEFT JOIN v ON m.e=v.e AND m.o=v.o GROUP BY 1""")
def q61_coverage(spark, d):
    o, lines = read(spark, d, "orders"), _lines(spark, d)
    m = lines.join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").cast("long").alias("year")), "l_orderkey").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("match_order"), "year")
    whole = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("event_id"), F.lit(None).cast("int").alias("match_order"))
    single = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").cast("int").alias("match_order"))
    return rollup.coverage(m, whole.unionByName(single))


@query("""WITH p AS (SELECT DISTINCT l_suppkey s, l_orderkey o FROM lineitem), n AS (SELECT s FROM p GROUP BY 1 HAVING count(*)>1), g AS (SELECT o, bool_or(n.s IS NOT NULL) x FROM p LEFT JOIN n USING (s) GROUP BY 1) SELECT count(*) FILTER (x) AS shared, count(*) AS groups FROM g""")
def q62_overlap_rate(spark, d):
    return repairs.overlap_rate(_lines(spark, d), "l_suppkey", "l_orderkey")


@query("""SELECT o_custkey, CASE WHEN min(CAST(o_orderdate AS DATE)) > DATE '2001-06-01' THEN 'after the corpus' ELSE 'one source' END AS why FROM orders GROUP BY 1 HAVING min(CAST(o_orderdate AS DATE)) > DATE '2001-06-01' OR count(DISTINCT o_orderpriority)<2""")
def q63_sole_source(spark, d):
    return repairs.sole_source(_orders(spark, d), ["o_custkey"], "o_orderpriority", "day", F.lit("2001-06-01").cast("date"))


# order


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_suppkey, l_partkey, l_linenumber) AS new_order FROM lineitem""")
def q64_renumber(spark, d):
    return timeline.renumber(_lines(spark, d), ["l_orderkey"], ["l_quantity", "l_suppkey", "l_partkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("new_order").cast("long").alias("new_order"))


@query("""WITH c AS (SELECT event_id, user_id, ts, CASE WHEN event_type='view' THEN CAST(floor(value) AS BIGINT) END v FROM events), w AS (SELECT *, row_number() OVER x AS r, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) b,
 first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) a FROM c WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(coalesce(v*1000, b*1000 + r, a*1000 - 1000 + r, r) AS BIGINT) AS thousandths FROM w""")
def q65_night_order(spark, d):
    e = read(spark, d, "events").withColumn("carried", F.when(F.col("event_type") == "view", F.floor("value")))
    return timeline.order_within_night(e, ["user_id"], ["ts", "event_id"], "carried").select("event_id", F.round(F.col("night_order") * 1000).cast("long").alias("thousandths"))


@query("""WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) a, CAST(l_shipdate AS DATE) b FROM orders JOIN lineitem ON o_orderkey=l_orderkey AND l_linenumber=1) SELECT o_orderkey, CAST(abs(date_diff('day', a, b)) AS BIGINT) AS days FROM p WHERE abs(date_diff('day', a, b)) > 400""")
def q66_off_dates(spark, d):
    first = read(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("date").alias("theirs"))
    pairs = _orders(spark, d).select("o_orderkey", F.col("day").alias("ours"), F.lit(None).cast("date").alias("aired")).join(first, "o_orderkey")
    return timeline.off_dates(pairs, 400).select("o_orderkey", F.col("days").cast("long").alias("days"))


@query("""WITH a AS (SELECT l_orderkey k, string_agg(l_suppkey, ',' ORDER BY l_linenumber, l_suppkey) f FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey k, string_agg(l_suppkey, ',' ORDER BY l_linenumber, l_suppkey) f FROM lineitem WHERE l_quantity<40 GROUP BY 1)
SELECT a.k AS night, a.f IS NOT DISTINCT FROM b.f AS same FROM a JOIN b ON a.k=b.k""")
def q67_same_night(spark, d):
    rows = _lines(spark, d).select(F.col("l_orderkey").alias("night"), "l_linenumber", "l_suppkey", "l_quantity")
    return timeline.same_night(rows, rows.where("l_quantity < 40"), "night", "l_linenumber", "l_suppkey")


@query("""WITH x AS (SELECT l_orderkey, l_suppkey, l_partkey, CAST(l_linenumber AS BIGINT) pos, 0 nw FROM lineitem UNION ALL SELECT l_orderkey, 0, l_partkey, CAST(l_linenumber AS BIGINT), 1 FROM lineitem WHERE l_quantity>45)
SELECT l_orderkey, l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, nw, l_suppkey, l_partkey) AS pos FROM x""")
def q68_insert_after(spark, d):
    old = _lines(spark, d).select("l_orderkey", "l_suppkey", "l_partkey", F.col("l_linenumber").cast("long").alias("pos"))
    new = _lines(spark, d).where("l_quantity > 45").select("l_orderkey", F.lit(0).cast("long").alias("l_suppkey"), "l_partkey", F.col("l_linenumber").cast("long").alias("anchor"))
    return repairs.insert_after(old, new, ["l_orderkey"], "pos", "anchor").withColumn("pos", F.col("pos").cast("long"))


# merging


@query("""WITH n AS (SELECT * FROM (SELECT l_orderkey AS k, l_suppkey AS s FROM lineitem) WHERE (k) NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus<>'F') QUALIFY row_number() OVER (PARTITION BY k ORDER BY s)=1)
SELECT o_orderkey AS k, o_custkey AS s FROM orders WHERE o_orderstatus<>'F' UNION ALL SELECT k, s FROM n""")
def q69_append_first_wins(spark, d):
    base = read(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("s"))
    new = _lines(spark, d).select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"))
    return reconcile.append_new(base, new, ["k"], ["s"])


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' UNION ALL SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01'""")
def q70_replace_range(spark, d):
    base = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    new = read(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz '1999-01-01'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"))
    return reconcile.replace_range(base, new, F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_totalprice")


_TWO = """a AS (SELECT c_custkey k, CASE WHEN c_acctbal>0 THEN c_mktsegment END x, c_acctbal y, c_name z FROM customer WHERE c_acctbal<6000), b AS (SELECT c_custkey k, c_name x, CASE WHEN c_acctbal<8000 THEN c_acctbal+1 END y, CASE WHEN c_acctbal<3000 THEN c_mktsegment END z FROM customer WHERE c_acctbal>-500)"""


def _two(spark, d):
    c = read(spark, d, "customer")
    bal, seg = F.col("c_acctbal"), F.col("c_mktsegment")
    a = c.where("c_acctbal < 6000").select(F.col("c_custkey").alias("k"), F.when(bal > 0, seg).alias("x"), bal.alias("y"), F.col("c_name").alias("z"))
    b = c.where("c_acctbal > -500").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("x"), F.when(bal < 8000, bal + 1).alias("y"), F.when(bal < 3000, seg).alias("z"))
    return a, b


@query(f"WITH {_TWO} SELECT coalesce(a.k,b.k) AS k, coalesce(a.x,b.x) AS x, coalesce(b.y,a.y) AS y, CASE WHEN b.k IS NOT NULL THEN b.z ELSE a.z END AS z FROM a FULL JOIN b ON a.k=b.k")
def q71_merge_policies(spark, d):
    return reconcile.merge(*_two(spark, d), ["k"], {"x": "keep", "y": "overwrite", "z": "replace"})


@query(f"WITH {_TWO} SELECT a.k, 'x' AS field, a.x AS old, b.x AS new FROM a JOIN b ON a.k=b.k AND a.x<>b.x UNION ALL SELECT a.k, 'z', a.z, b.z FROM a JOIN b ON a.k=b.k AND a.z<>b.z")
def q72_conflicts(spark, d):
    return reconcile.conflicts(*_two(spark, d), ["k"], ["x", "z"])


@query("""WITH t AS (SELECT CAST(n_nationkey AS BIGINT) id, n_name AS name FROM nation), f AS (SELECT DISTINCT c_mktsegment n FROM customer UNION SELECT n_name FROM nation), x AS (SELECT n FROM f WHERE n NOT IN (SELECT name FROM t))
SELECT id, name FROM t UNION ALL SELECT (SELECT max(id) FROM t) + row_number() OVER (ORDER BY n), n FROM x""")
def q73_get_or_create(spark, d):
    table = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    names = read(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).unionByName(table.select("name"))
    return reconcile.get_or_create(names, table, "name", "id")


@query("""WITH m(v,t) AS (VALUES ('F','finished'),('O','open'),('P','pending')) SELECT o_orderkey, t AS o_orderstatus FROM orders JOIN m ON o_orderstatus=v""")
def q74_translate(spark, d):
    return reconcile.translate(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", _values(spark, "value, meaning", "('F', 'finished'), ('O', 'open'), ('P', 'pending')"))


@query("""WITH p AS (SELECT l_orderkey k, string_agg(DISTINCT l_suppkey, '|' ORDER BY l_suppkey) FILTER (l_linenumber<=3) a, string_agg(DISTINCT l_suppkey, '|' ORDER BY l_suppkey) FILTER (l_linenumber<=2) b, string_agg(DISTINCT l_suppkey, '|' ORDER BY l_suppkey) FILTER (l_linenumber<=2 AND l_quantity<25) c,
 len(list_distinct(list(l_suppkey) FILTER (l_linenumber<=3))) sa, len(list_distinct(list_concat(list(l_suppkey) FILTER (l_linenumber<=2), list(l_suppkey) FILTER (l_linenumber<=2 AND l_quantity<25)))) u FROM lineitem GROUP BY 1)
SELECT k AS l_orderkey, CASE WHEN a IS NULL AND b=c THEN 'add' WHEN c IS NULL THEN 'review' WHEN a=c THEN 'keep' WHEN b=c THEN 'fix' WHEN u=sa THEN 'split' ELSE 'review' END AS verdict FROM p""")
def q75_verdicts(spark, d):
    some = lambda c: F.sort_array(F.collect_set(F.when(c, F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))))
    null = lambda c: F.when(F.size(c) > 0, F.col(c))
    p = _lines(spark, d).groupBy("l_orderkey").agg(some(F.col("l_linenumber") <= 3).alias("a"), some(F.col("l_linenumber") <= 2).alias("b"), some((F.col("l_linenumber") <= 2) & (F.col("l_quantity") < 25)).alias("c"))
    return p.select("l_orderkey", F.coalesce(reconcile.verdict(null("a"), null("b"), null("c"), F.lit("lineup"), F.lit(True)), F.lit("review")).alias("verdict"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal<0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal<-500 THEN 'x' ELSE c_name END AS c_name FROM customer""")
def q76_patches(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name", "c_acctbal")
    p = c.where("c_acctbal < 0").select("c_custkey", F.substring("c_name", 1, 9).alias("guard_text"), F.lit("c_mktsegment").alias("field"), F.lit("DEBT").alias("value"))
    q = c.where("c_acctbal < -500").select("c_custkey", F.substring("c_name", 1, 9).alias("guard_text"), F.lit("c_name").alias("field"), F.lit("x").alias("value"))
    return reconcile.patch(c, p.unionByName(q), "c_custkey", "c_name", ["c_mktsegment", "c_name"]).drop("c_acctbal")


@query("""WITH r(c,e,p) AS (VALUES ('F','1-URGENT','10'),('O','2-HIGH','2')) SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM r WHERE c=o_orderstatus AND e=o_orderpriority AND starts_with(CAST(o_custkey AS VARCHAR), p))""")
def q77_ruled_rows(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("class"), F.col("o_orderpriority").alias("event"), F.lit(None).cast("string").alias("match"), F.col("o_custkey").cast("string").alias("line"))
    r = _values(spark, "class, event, match, prefix", "('F', '1-URGENT', CAST(NULL AS STRING), '10'), ('O', '2-HIGH', CAST(NULL AS STRING), '2')")
    return reconcile.without_ruled(o, r).select("o_orderkey")


@query("""WITH v AS (SELECT o_custkey k, o_orderpriority s, CAST(o_orderdate AS DATE) d, min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey) m FROM orders), c AS (SELECT k, m, date_trunc('year', d) y, s FROM v),
 n AS (SELECT k, date_trunc('year', m) o, y, count(DISTINCT s) votes FROM c GROUP BY 1,2,3), x AS (SELECT *, coalesce(max(votes) FILTER (y=o) OVER (PARTITION BY k),0) mine FROM n),
 b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY votes DESC, y) r, lead(votes) OVER (PARTITION BY k ORDER BY votes DESC, y) nx FROM x WHERE y<>o), t AS (SELECT k FROM (SELECT k, s, count(*) FILTER (y=date_trunc('year', m)) a, count(*) FILTER (y<>date_trunc('year', m)) b FROM c GROUP BY 1,2) WHERE a>0 AND b>0)
SELECT k AS o_custkey, CAST(y AS DATE) AS day, votes FROM b WHERE r=1 AND votes>mine AND (nx IS NULL OR nx<votes) AND k NOT IN (SELECT k FROM t)""")
def q78_date_votes(spark, d):
    from pyspark.sql import Window

    o = _orders(spark, d)
    claims = o.select("o_custkey", F.trunc("day", "YEAR").alias("day"), F.col("o_orderpriority").alias("source"), F.trunc(F.min("day").over(Window.partitionBy("o_custkey")), "YEAR").alias("ours"))
    return repairs.date_votes(claims, "o_custkey", "day", "source", "ours")


@query("""SELECT o_orderkey, o_orderpriority AS verdict, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS nr FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH')""")
def q79_auto_fixes(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("verdict"))
    return repairs.auto_fixes(rows, ["1-URGENT", "2-HIGH"], ["verdict", "o_orderkey"])


@query("""WITH x AS (SELECT o_orderkey, o_orderstatus='P' f, CAST(o_orderdate AS DATE) d, CAST(o_orderdate AS DATE)+5 h FROM orders), t AS (SELECT DISTINCT d FROM x WHERE NOT f) SELECT o_orderkey, CASE WHEN f AND d IN (SELECT d FROM t) THEN h ELSE d END AS day FROM x""")
def q80_settled_dates(spark, d):
    rows = _orders(spark, d).select("o_orderkey", "day", F.date_add("day", 5).alias("header"), (F.col("o_orderstatus") == "P").alias("flagged"))
    return repairs.settled_dates(rows, "day", "header", "flagged", "o_orderkey")


@query("""SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS shows FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity>=50) GROUP BY 1""")
def q81_occupied_dates(spark, d):
    dropped = _lines(spark, d).where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return repairs.occupied(_orders(spark, d), "day", "o_orderkey", dropped)


@query("""WITH w AS (SELECT l_orderkey e, l_suppkey p, count(*) n, count(*) FILTER (l_quantity>40) t, min(l_linenumber) m, min(l_linenumber) FILTER (l_quantity>40) tm FROM lineitem WHERE l_returnflag='A' GROUP BY 1,2)
SELECT e AS l_orderkey, p AS l_suppkey, CASE WHEN n=1 THEN m ELSE tm END AS l_linenumber FROM w WHERE n=1 OR t=1""")
def q82_only_win(spark, d):
    rows = _lines(spark, d).withColumn("won", F.col("l_returnflag") == "A").withColumn("title", F.col("l_quantity") > 40)
    return repairs.only_win(rows, "l_orderkey", "l_suppkey", "won", "title", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_returnflag='N' THEN 'draw' WHEN l_quantity<10 THEN CASE WHEN l_returnflag='A' THEN 'win_dq' ELSE 'loss_dq' END WHEN l_quantity<20 THEN CASE WHEN l_returnflag='A' THEN 'win_countout' ELSE 'loss_countout' END ELSE CASE WHEN l_returnflag='A' THEN 'win' ELSE 'loss' END END AS outcome FROM lineitem""")
def q83_rewritten_results(spark, d):
    rows = _lines(spark, d)
    kind = F.when(F.col("l_returnflag") == "N", "draw").when(F.col("l_quantity") < 10, "dq").when(F.col("l_quantity") < 20, "countout").otherwise("pinfall")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", repairs.rewritten_result(F.when(F.col("l_returnflag") == "A", "win").otherwise("loss_dq"), kind).alias("outcome"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus='P' THEN CAST(o_orderdate AS DATE)+7 ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderstatus='P' AND o_totalprice>100000 THEN 'moved' ELSE o_orderpriority END AS title FROM orders""")
def q84_moved_records(spark, d):
    o = _orders(spark, d).select("o_orderkey", "day", F.col("o_orderpriority").alias("title"), "o_orderstatus", "o_totalprice")
    moves = o.where("o_orderstatus = 'P'").select("o_orderkey", F.date_add("day", 7).alias("day"), F.when(F.col("o_totalprice") > 100000, "moved").alias("title"))
    return repairs.moved_records(o.select("o_orderkey", "day", "title"), moves, "o_orderkey", ["day", "title"])


@query("""SELECT o_orderkey + 10000000 AS o_orderkey, o_custkey, 'new' AS o_orderpriority, CAST(o_orderdate AS DATE)+7 AS day FROM orders WHERE o_orderstatus='P'""")
def q85_synthesized_records(spark, d):
    o = _orders(spark, d).select("o_orderkey", "o_custkey", "o_orderpriority", "day", "o_orderstatus")
    wanted = o.where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), F.col("o_orderkey").alias("template"), F.lit("new").alias("o_orderpriority"), F.date_add("day", 7).alias("day"))
    return repairs.synthesized(o.drop("o_orderstatus"), wanted, "o_orderkey", "template", ["o_orderpriority", "day"])


@query("""SELECT o_orderkey, o_orderpriority AS old, 'done' AS new FROM orders WHERE o_orderstatus='F' AND o_totalprice>50000""")
def q86_dry_run(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    p = o.where("o_orderstatus = 'F'").select("o_orderkey", F.when(F.col("o_totalprice") > 50000, "done").otherwise(F.col("o_orderpriority")).alias("value"))
    return repairs.plan_and_apply(o, p, "o_orderkey", "o_orderpriority", dry_run=True)


@query("""WITH b AS (SELECT l_orderkey k, l_partkey u, min(l_suppkey) s FROM lineitem WHERE l_quantity<20 GROUP BY 1,2), n AS (SELECT l_orderkey k, l_partkey u, min(l_suppkey) s FROM lineitem WHERE l_quantity>10 GROUP BY 1,2)
SELECT k AS l_orderkey, u AS l_partkey, s AS l_suppkey FROM b UNION ALL SELECT k, u, s FROM n WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k=n.k AND b.u=n.u)""")
def q87_merged_media(spark, d):
    rows = _lines(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return repairs.merged_media(rows.where("l_quantity < 20").drop("l_quantity"), rows.where("l_quantity > 10").drop("l_quantity"), ["l_orderkey"], "l_partkey")


@query("""SELECT l_partkey, count(DISTINCT l_orderkey) AS ids FROM lineitem WHERE l_quantity>40 GROUP BY 1 HAVING count(DISTINCT l_orderkey)>1""")
def q88_shared_numbers(spark, d):
    return repairs.shared_numbers(_lines(spark, d).where("l_quantity > 40"), "l_partkey", "l_orderkey")


@query("""SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus='F' UNION SELECT o_custkey, o_orderpriority FROM orders""")
def q89_source_log(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    log = o.where("o_orderstatus = 'F'").drop("o_orderstatus").distinct()
    return repairs.logged(repairs.logged(log, o.drop("o_orderstatus"), ["o_custkey", "o_orderpriority"]), o.drop("o_orderstatus"), ["o_custkey", "o_orderpriority"])


@query("""WITH p AS (SELECT DISTINCT l_orderkey k, CAST(l_linenumber AS BIGINT) n FROM lineitem), o AS (SELECT k, n, k*10+n AS id FROM p WHERE n<=3), f AS (SELECT k, n FROM p WHERE n>3)
SELECT k, n, id FROM o UNION ALL SELECT k, n, 100000000 + row_number() OVER (ORDER BY k, n) FROM f""")
def q90_stable_children(spark, d):
    p = _lines(spark, d).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n")).distinct()
    prior = p.where("n <= 3").withColumn("id", F.col("k") * 10 + F.col("n"))
    return repairs.stable_children(p, prior, "k", "n", 100_000_000)


# people


@query("""WITH x AS (SELECT o_custkey AS name, count(DISTINCT o_orderpriority) AS workers FROM orders GROUP BY 1) SELECT name, workers FROM x WHERE workers>1""")
def q91_shared_names(spark, d):
    return entity.shared_names(read(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("worker")))


@query("""SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS keeper FROM customer""")
def q92_keepers(spark, d):
    return entity.keepers(read(spark, d, "customer").withColumn("canonical", F.concat_ws("|", "c_nationkey", "c_mktsegment")), "c_custkey", "canonical")


@query("""WITH n AS (SELECT p_name AS name, regexp_replace(lower(strip_accents(CASE WHEN lower(p_name) LIKE 'small %' THEN 'The ' || substr(p_name, 7) ELSE p_name END)), '^the\\s+', '') k FROM part)
SELECT DISTINCT name, regexp_replace(k, '[^a-z0-9]', '', 'g') AS key FROM n""")
def q93_name_keys(spark, d):
    told = F.when(F.lower("p_name").startswith("small "), F.concat(F.lit("The "), F.substr("p_name", F.lit(7)))).otherwise(F.col("p_name"))
    return read(spark, d, "part").select(F.col("p_name").alias("name"), told.alias("told")).distinct().select("name", text.normkey("told").alias("key"))


@query("""WITH r AS (SELECT DISTINCT lower(p_brand) slug FROM part), a AS (SELECT DISTINCT p_brand AS asset FROM part UNION SELECT DISTINCT lower(replace(p_brand,'#','')) FROM part), n AS (SELECT regexp_replace(slug,'[^a-z0-9]','','g') l, count(*) c, min(slug) s FROM r GROUP BY 1 HAVING count(*)=1)
SELECT asset, CASE WHEN asset='Brand#1' THEN NULL WHEN asset='Brand#2' THEN 'two' ELSE n.s END AS slug, CASE WHEN asset='Brand#1' THEN 'skipped' WHEN asset='Brand#2' THEN 'manual' WHEN n.s IS NOT NULL THEN 'normalized' ELSE 'none' END AS rule FROM a LEFT JOIN n ON regexp_replace(lower(asset),'[^a-z0-9]','','g')=n.l""")
def q94_resolved_slugs(spark, d):
    p = read(spark, d, "part").select("p_brand").distinct()
    assets = p.select(F.col("p_brand").alias("asset")).unionByName(p.select(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("asset"))).distinct()
    return entity.resolved_slugs(assets, p.select(F.lower("p_brand").alias("slug")), _values(spark, "asset, slug", "('Brand#2', 'two')"), ["Brand#1"])


@query("""WITH c AS (SELECT DISTINCT l_orderkey e, 'P' || l_suppkey || ' S' || (l_suppkey % 10) AS name FROM lineitem), m AS (SELECT e, name AS mention FROM c UNION SELECT e, 'S3' FROM c UNION SELECT e, 'nobody' FROM c),
 l AS (SELECT e, split_part(name,' ',2) s, count(*) n, min(name) v FROM c GROUP BY 1,2 HAVING count(*)=1)
SELECT m.e AS event, mention, coalesce(c.name, l.v) AS name, CASE WHEN c.name IS NOT NULL THEN 'explicit' WHEN l.v IS NOT NULL THEN 'surname' ELSE 'unresolved' END AS rule FROM m LEFT JOIN c ON m.e=c.e AND mention=c.name LEFT JOIN l ON m.e=l.e AND mention=l.s""")
def q95_resolved_sides(spark, d):
    name = F.concat(F.lit("P"), F.col("l_suppkey").cast("string"), F.lit(" S"), (F.col("l_suppkey") % 10).cast("string"))
    cast = _lines(spark, d).select(F.col("l_orderkey").alias("event"), name.alias("name")).distinct()
    extra = cast.select("event").distinct()
    mentions = cast.select("event", F.col("name").alias("mention")).unionByName(extra.withColumn("mention", F.lit("S3"))).unionByName(extra.withColumn("mention", F.lit("nobody")))
    return entity.resolved_side(mentions, cast)


# checks


@query("""SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1,2 HAVING count(*)>1""")
def q96_duplicates(spark, d):
    return gates.duplicates(read(spark, d, "orders"), ["o_custkey", "o_orderpriority"]).withColumnRenamed("count", "n")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus='F')""")
def q97_orphans(spark, d):
    parents = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return gates.orphans(_lines(spark, d), parents, "l_orderkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH','3-MEDIUM')""")
def q98_not_in_set(spark, d):
    return gates.not_in_set(read(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("o_orderkey")


# text and dates


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html,'<[^>]*>','','g'),'&quot;','"'),'&#39;',''''),'&apos;',''''),'&nbsp;',' '),'&lt;','<'),'&gt;','>'),'&amp;','&'),'\\s+',' ','g')) AS plain FROM pages""")
def q99_strip_tags(spark, d):
    return read(spark, d, "pages").select("page_id", text.strip_tags("html").alias("plain"))


@query("""WITH s AS (SELECT DISTINCT p_name || ' & ' || p_type || ' vs. ' || p_brand AS line FROM part) SELECT line, len(string_split(line,' vs. ')) AS sides, trim(string_split(string_split(line,' vs. ')[1],' & ')[2]) AS second FROM s""")
def q100_sides(spark, d):
    line = F.concat("p_name", F.lit(" & "), "p_type", F.lit(" vs. "), "p_brand")
    s = read(spark, d, "part").select(line.alias("line")).distinct().withColumn("s", text.sides("line"))
    return s.select("line", F.size("s").cast("long").alias("sides"), F.get(F.get("s", F.lit(0)), F.lit(1)).alias("second"))


@query("""SELECT s_suppkey, 'Hall ' || s_suppkey AS venue, n_name AS city, r_name AS country FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""")
def q101_locations(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    told = read(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("Hall "), F.col("s_suppkey").cast("string"), F.lit(" in "), "n_name", F.lit(", "), "r_name").alias("place"))
    return told.withColumn("l", text.location("place")).select("s_suppkey", "l.venue", "l.city", "l.country")


@query("""SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 10800 AS seconds FROM orders WHERE CAST(floor(o_totalprice) AS BIGINT) % 10800 < 3600""")
def q102_durations(spark, d):
    s = F.floor("o_totalprice") % 10800
    told = F.format_string("(%d:%02d)", F.floor(s / 60), s % 60)
    return read(spark, d, "orders").where(s < 3600).select("o_orderkey", dates.duration_seconds(told).cast("long").alias("seconds"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) AS c FROM orders""")
def q103_written_dates(spark, d):
    told = lambda f: F.date_format("day", f)
    return _orders(spark, d).select("o_orderkey", dates.any_date(told("dd.MM.yyyy")).alias("a"), dates.any_date(told("MMMM d, yyyy")).alias("b"), dates.any_date(told("M/d/yy")).alias("c"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST((CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 4 WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 5 ELSE 2 END - isodow(o_orderdate) + 7) % 7 AS INTEGER) AS air_date,
 CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' AND isodow(o_orderdate)=2 THEN 'live-broadcast' ELSE 'air-night-estimate' END AS derivation FROM orders""")
def q104_air_eras(spark, d):
    eras = [("1900-01-01", "Thu", False), ("1997-01-01", "Fri", False), ("2000-01-01", "Tue", True)]
    return _orders(spark, d).withColumn("a", dates.air_day("day", eras)).select("o_orderkey", "a.air_date", "a.derivation")


@query("""SELECT CAST(strftime(o_orderdate,'%Y') AS BIGINT) AS y, count(*) AS n, count(DISTINCT strftime(o_orderdate,'%Y') || '0101') AS lo FROM orders GROUP BY 1""")
def q105_date_bounds(spark, d):
    return _orders(spark, d).groupBy(F.year("day").cast("long").alias("y")).agg(F.count("*").alias("n"), F.countDistinct(dates.bound(F.year("day"), True)).alias("lo"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN o_totalprice WHEN o_orderpriority='1-URGENT' THEN 1.0 END AS price, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag FROM orders""")
def q106_defaults_by_source(spark, d):
    price = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    flag = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    return read(spark, d, "orders").select("o_orderkey", repairs.default_by_source(price, F.lit(1.0), F.col("o_orderpriority"), "1-URGENT").alias("price"), repairs.tri_state(flag).alias("flag"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Big Night' WHEN '2-HIGH' THEN 'Weekly #' || o_orderkey ELSE 'Weekly' END AS title, CAST(o_orderdate AS DATE) d FROM orders)
SELECT o_orderkey, CASE WHEN NOT (title LIKE 'Big%' OR (title LIKE 'Weekly%' AND title LIKE '%#%')) THEN 'skip' WHEN d < DATE '1996-01-01' THEN 'too_old' WHEN d > DATE '2000-12-31' THEN 'too_new' ELSE 'keep' END AS verdict FROM t""")
def q107_discovery(spark, d):
    title = F.when(F.col("o_orderpriority") == "1-URGENT", "Big Night").when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("Weekly #"), F.col("o_orderkey").cast("string"))).otherwise("Weekly")
    return _orders(spark, d).select("o_orderkey", repairs.discovered(title, F.col("day"), ["Big"], ["Weekly"], "1996-01-01", "2000-12-31").alias("verdict"))


@query("""WITH v AS (SELECT event_id, CASE WHEN event_type='view' THEN 'show' ELSE 'match' END kind, value*30 s, event_type='click' part FROM events)
SELECT event_id, CASE WHEN kind='show' AND NOT part AND s<2700 THEN 'short_show' WHEN kind='match' AND s>3600 THEN 'long_match' WHEN kind='match' AND s<60 THEN 'short_match' END AS flag FROM v""")
def q108_duration_flags(spark, d):
    e, kind = read(spark, d, "events"), F.when(F.col("event_type") == "view", "show").otherwise("match")
    return e.select("event_id", repairs.duration_flag(kind, F.col("value") * 30, F.col("event_type") == "click").alias("flag"))


@query("""WITH s(id, kind, title, belt) AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Tournament Semi Final' WHEN '2-HIGH' THEN 'Best of Seven Series' ELSE 'Singles' END, CASE WHEN o_totalprice>100000 THEN 'TITLE CHANGE !!!' ELSE '' END, o_orderstatus || ' Championship' FROM orders)
SELECT id AS event_id, CASE belt WHEN 'F Championship' THEN 'belt::f' WHEN 'O Championship' THEN 'belt::o' ELSE 'belt::p' END AS lineage, title<>'' AS marked FROM s WHERE kind<>'Tournament Semi Final' AND NOT (kind='Best of Seven Series' AND title='') AND id NOT IN (221,471,770,831)""")
def q109_walk_steps(spark, d):
    from ..sources import schema
    from .jobs import steps

    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "Tournament Semi Final").when(F.col("o_orderpriority") == "2-HIGH", "Best of Seven Series").otherwise("Singles")
    raw = F.when(F.col("o_totalprice") > 100000, "TITLE CHANGE !!!").otherwise("")
    team = F.struct(F.lit(1).alias("team_number"), F.lit("t").alias("team_name"), F.lit(None).cast("string").alias("accompaniment"), F.lit(True).alias("was_winner"), F.lit(None).cast("string").alias("match_outcome"), F.lit(False).alias("was_champion_entering"), F.array(F.col("o_custkey").cast("string")).alias("participants"))
    null = lambda t: F.lit(None).cast(t)
    match = F.struct(F.lit(1).alias("match_order"), kind.alias("match_type"), null("string").alias("stipulation"), F.concat("o_orderstatus", F.lit(" Championship")).alias("title_at_stake"), null("int").alias("duration_seconds"), null("string").alias("result_method"), null("double").alias("match_guide_rating"), raw.alias("raw_description"), F.array(team).alias("teams"), null(f"array<{schema.RULING}>").alias("title_result"))
    events = _orders(spark, d).select(F.col("o_orderkey").alias("event_id"), F.col("day").alias("air_date"), F.lit("RAW").alias("show_type"), F.lit("x").alias("title"), F.array(match).alias("matches"))
    return steps(events).select("event_id", "lineage", "marked")


@query("""SELECT CAST(o_orderdate AS DATE) AS air_date, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1""")
def q110_calendar(spark, d):
    return cards.calendar(_orders(spark, d).select(F.col("day").alias("air_date"), F.col("o_orderkey").alias("event_id"))).select("air_date", F.array_join("ids", ",").alias("ids"))


@query("""WITH p AS (SELECT l_orderkey k, l_linenumber n, string_agg(DISTINCT l_suppkey, '|' ORDER BY l_suppkey) s, min(CASE WHEN l_quantity>25 THEN l_quantity END) q FROM lineitem GROUP BY 1,2), x AS (SELECT k, s, min(q) q FROM p WHERE q IS NOT NULL GROUP BY 1,2 HAVING count(*)=1)
SELECT p.k, p.n, coalesce(p.q, x.q) AS q FROM p LEFT JOIN x ON p.k=x.k AND p.s=x.s""")
def q111_filled_by_people(spark, d):
    rows = _lines(spark, d).groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("people"), F.min(F.when(F.col("l_quantity") > 25, F.col("l_quantity"))).alias("q"))
    return repairs.filled_by_people(rows, rows, "k", "people", "q").select("k", "n", "q")


@query("""SELECT 'price' AS field, count(CASE WHEN o_totalprice>100000 THEN 1 END) AS n FROM orders UNION ALL SELECT 'status', count(nullif(o_orderstatus,'P')) FROM orders""")
def q112_field_coverage(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"), F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return repairs.field_coverage(repairs.with_content(rows, "o_orderkey", ["price", "status"]), ["price", "status"])


# histories


@query("""SELECT CAST(o_orderdate AS DATE) AS day, string_agg(o_custkey, ',' ORDER BY o_orderkey DESC) AS winners FROM orders GROUP BY 1""")
def q113_nights(spark, d):
    n = histories.nights(_orders(spark, d).select("day", "o_orderkey", F.col("o_custkey").cast("string").alias("who")), "day", "o_orderkey", "who", newest_first=True)
    return n.select("day", F.array_join("winners", ",").alias("winners"))


@query("""WITH e AS (SELECT CAST(o_orderdate AS DATE) air, CASE WHEN o_totalprice>150000 THEN CAST(o_orderdate AS DATE)-2 END tape FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH')) SELECT air AS day FROM e UNION SELECT coalesce(tape, air) FROM e""")
def q114_carried_dates(spark, d):
    e = _orders(spark, d).select(F.col("o_orderpriority").alias("show_type"), F.col("day").alias("air_date"), F.when(F.col("o_totalprice") > 150000, F.date_sub("day", 2)).alias("tape_date"))
    return histories.carried_dates(e, ["1-URGENT", "2-HIGH"])


@query("""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) h, CASE WHEN o_orderstatus='P' THEN CAST(o_orderdate AS DATE)-10 WHEN o_totalprice>200000 THEN CAST(o_orderdate AS DATE)+3 END n, o_orderpriority='1-URGENT' c, CAST(o_orderdate AS DATE)+1 l, o_orderpriority='2-HIGH' lc FROM orders)
SELECT o_orderkey, CASE WHEN n IS NOT NULL THEN CASE WHEN n>=h THEN n ELSE CAST(n + INTERVAL 12 MONTH AS DATE) END WHEN c THEN h WHEN lc THEN l ELSE h END AS day FROM x""")
def q115_seen_dates(spark, d):
    noted = F.when(F.col("o_orderstatus") == "P", F.date_sub("day", 10)).when(F.col("o_totalprice") > 200000, F.date_add("day", 3))
    o = F.col("o_orderpriority")
    return _orders(spark, d).select("o_orderkey", histories.air_date(F.col("day"), noted, o == "1-URGENT", F.date_add("day", 1), o == "2-HIGH").alias("day"))


@query("""WITH e(title,name,lo,hi,r) AS (VALUES ('1-URGENT','first',NULL::DATE,DATE '1997-12-31',1),('1-URGENT','second',DATE '1997-06-01',NULL::DATE,2),('2-HIGH','other',DATE '1999-01-01',NULL::DATE,1))
SELECT o_orderkey, coalesce(name, o_orderpriority) AS lineage_name FROM orders LEFT JOIN e ON title=o_orderpriority AND (lo IS NULL OR CAST(o_orderdate AS DATE)>=lo) AND (hi IS NULL OR CAST(o_orderdate AS DATE)<=hi) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY r)=1""")
def q116_lineage_names(spark, d):
    eras = _values(spark, "title, name, lo, hi, rank", "('1-URGENT', 'first', CAST(NULL AS DATE), DATE '1997-12-31', 1), ('1-URGENT', 'second', DATE '1997-06-01', CAST(NULL AS DATE), 2), ('2-HIGH', 'other', DATE '1999-01-01', CAST(NULL AS DATE), 1)")
    return histories.lineage_name(_orders(spark, d).select("o_orderkey", "o_orderpriority", "day"), F.broadcast(eras), "o_orderpriority", "day").select("o_orderkey", "lineage_name")


@query("""SELECT l_orderkey, string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber) AS orders FROM lineitem WHERE l_returnflag='R' GROUP BY 1""")
def q117_pre_shows(spark, d):
    rows = _lines(spark, d).withColumn("note", F.when(F.col("l_returnflag") == "R", " Pre-show").otherwise("x"))
    return histories.pre_show(rows, "l_orderkey", "l_linenumber", "note").select("l_orderkey", F.array_join(F.col("orders").cast("array<string>"), ",").alias("orders"))


@query("""SELECT o_orderpriority AS lineage, l_suppkey AS name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2""")
def q118_appearance_counts(spark, d):
    people = _lines(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_suppkey").alias("people"))
    return histories.appearance_counts(read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("lineage")).join(people, "o_orderkey"), "lineage", "people")


@query("""WITH s AS (SELECT l_orderkey k, list(DISTINCT l_suppkey) FILTER (l_quantity<30) a, list(DISTINCT l_suppkey) FILTER (l_quantity>20) b FROM lineitem GROUP BY 1 HAVING a IS NOT NULL AND b IS NOT NULL)
SELECT k AS l_orderkey, list_aggregate(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), 'string_agg', ',') AS missing, list_aggregate(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), 'string_agg', ',') AS extra FROM s""")
def q119_side_differences(spark, d):
    s = _lines(spark, d).groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_quantity") < 30, F.col("l_suppkey"))).alias("a"), F.collect_set(F.when(F.col("l_quantity") > 20, F.col("l_suppkey"))).alias("b")).where("size(a) > 0 AND size(b) > 0")
    told = lambda f: F.when(F.size(f"x.{f}") > 0, F.array_join(F.col(f"x.{f}").cast("array<string>"), ",")).alias(f)
    return s.withColumn("x", histories.side_differences(F.col("a"), F.col("b"))).select("l_orderkey", told("missing"), told("extra"))


@query("""WITH x AS (SELECT DISTINCT p_name || CASE WHEN p_size<20 THEN ' defeated ' WHEN p_size<30 THEN ' vs. ' ELSE ' and ' END || p_type AS line, p_size<30 AS is_match FROM part) SELECT line, is_match FROM x""")
def q120_match_rows(spark, d):
    verb = F.when(F.col("p_size") < 20, " defeated ").when(F.col("p_size") < 30, " vs. ").otherwise(" and ")
    return read(spark, d, "part").select(F.concat("p_name", verb, "p_type").alias("line")).distinct().select("line", text.is_match_row("line").alias("is_match"))


@query("""SELECT o_orderkey, date_trunc('month', CAST(o_orderdate AS DATE))::DATE AS month, CAST(date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders""")
def q121_month_starts(spark, d):
    return _orders(spark, d).select("o_orderkey", dates.month_start(F.date_format("day", "MMM yyyy")).alias("month"), dates.days_apart(F.col("day"), F.lit("1998-01-01").cast("date")).cast("long").alias("days"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<a [^>]*href="/[^"]*"[^>]*>([^<]*)</a>')) AS BIGINT) AS links, CAST(len(list_filter(list_transform(regexp_split_to_array(html, '(?i)<br\\s*/?>|</?p>'), lambda x: trim(regexp_replace(regexp_replace(x,'<[^>]*>','','g'),'\\s+',' ','g'))), lambda x: x<>'')) AS BIGINT) AS lines FROM pages""")
def q122_page_lines(spark, d):
    stake = text.linked_stake("html", "/")
    return read(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a [^>]*href="/[^"]*"[^>]*>([^<]*)</a>'), F.lit(1))).cast("long").alias("links"), F.size(text.line_texts("html")).cast("long").alias("lines"), stake.alias("_s")).drop("_s")
