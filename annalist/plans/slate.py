"""The query slate: the reference operators on the supplied tables, and their SQL.

Each query runs over whole tables through the library's operators; ORACLE_SQL holds the same query for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import cards, gates, joins, reconcile, rollup, timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT o_orderkey, o_custkey, o_orderdate, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey=o.o_orderkey) AS n_lines
FROM orders o WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1996-03-01'""")
def q01_month_calendar(spark, d):
    month = read(spark, d, "orders").where("o_orderdate >= timestamp_ntz '1996-02-01' AND o_orderdate < timestamp_ntz '1996-03-01'")
    lines = read(spark, d, "lineitem").join(month.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    return month.join(lines, month.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", "o_custkey", "o_orderdate", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query("""SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus='F') AS w, count(*) FILTER (o_orderstatus='O') AS l,
 count(*) FILTER (o_orderstatus='P') AS d, min(o_orderdate) AS first_d, max(o_orderdate) AS last_d,
 CASE WHEN count(*)>=10 THEN CAST((2000*count(*) FILTER (o_orderstatus='F')+count(*))//(2*count(*)) AS BIGINT) END AS permille
FROM orders GROUP BY 1""")
def q02_person_index(spark, d):
    return rollup.person_index(read(spark, d, "orders"), "o_custkey", F.col("o_orderstatus"), "o_orderdate", win="F", loss="O", draw="P")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)=1""")
def q03_longest(spark, d):
    best = read(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b"))
    return best.select("o_custkey", (-F.col("b.k")).alias("o_orderkey"), "b.o_totalprice")


@query("""WITH p AS (SELECT DISTINCT l_orderkey k, l_suppkey s FROM lineitem)
SELECT a.s AS s1, b.s AS s2, count(*) AS n FROM p a JOIN p b ON a.k=b.k AND a.s<>b.s GROUP BY 1,2""")
def q04_pair_counts(spark, d):
    return rollup.pair_counts(read(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("""WITH p AS (SELECT DISTINCT l_orderkey k, l_suppkey s FROM lineitem),
 c AS (SELECT a.s s1, b.s s2, count(*) n FROM p a JOIN p b ON a.k=b.k AND a.s<>b.s GROUP BY 1,2)
SELECT s1, s2, n FROM c QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY n DESC, s2)<=5""")
def q05_topk_partners(spark, d):
    return rollup.top_k(rollup.pair_counts(read(spark, d, "lineitem"), "l_orderkey", "l_suppkey"), ["s1"], [F.desc("n"), "s2"], 5)


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)<=10""")
def q06_latest_n(spark, d):
    return rollup.top_k(read(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id")


@query("""WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS chg FROM events),
 s AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM f),
 r AS (SELECT user_id, CAST(isl AS BIGINT) AS isl, min(event_type) AS holder, min(ts) AS start_ts, count(*) AS n FROM s GROUP BY 1,2)
SELECT user_id, isl, holder, start_ts, lead(start_ts) OVER (PARTITION BY user_id ORDER BY isl) AS end_ts, n FROM r""")
def q07_reigns_core(spark, d):
    rows = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return timeline.reigns(rows, ["user_id"], ["ts", "event_id"], "event_type", "ts")


@query("""WITH f AS (SELECT *, CASE WHEN date_diff('day', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts)>1 AND lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)<>event_type THEN 1 ELSE 0 END AS brk FROM events)
SELECT user_id, event_id, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lineage FROM f""")
def q08_era_break(spark, d):
    from pyspark.sql import Window

    days = F.datediff("ts", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    rows = read(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return timeline.era_breaks(rows, ["user_id"], ["ts", "event_id"], "event_type", days, most=1).select("user_id", "event_id", "lineage")


@query("""WITH m AS (SELECT max(ts) AS corpus_end FROM events)
SELECT user_id, CASE WHEN date_diff('day', max(ts), (SELECT corpus_end FROM m))>1 THEN max(ts) END AS closed_at FROM events GROUP BY 1""")
def q09_trailing_close(spark, d):
    return timeline.trailing_close(read(spark, d, "events"), ["user_id"], "ts", most=1)


@query("""WITH era(name,lo,hi) AS (VALUES ('a',NULL::DATE,DATE '1996-12-31'),('b',DATE '1997-01-01',DATE '1999-12-31'),('c',DATE '1999-06-01',NULL))
SELECT o_orderkey, name FROM orders JOIN era ON (lo IS NULL OR CAST(o_orderdate AS DATE)>=lo) AND (hi IS NULL OR CAST(o_orderdate AS DATE)<=hi)""")
def q10_validity_join(spark, d):
    eras = spark.sql("SELECT * FROM VALUES ('a', CAST(NULL AS DATE), DATE '1996-12-31'), ('b', DATE '1997-01-01', DATE '1999-12-31'), ('c', DATE '1999-06-01', CAST(NULL AS DATE)) AS era(name, lo, hi)")
    return joins.validity_join(read(spark, d, "orders"), F.broadcast(eras), F.col("o_orderdate").cast("date")).select("o_orderkey", "name")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST((5-isodow(o_orderdate)+7)%7 AS INTEGER) AS air FROM orders""")
def q11_next_air_day(spark, d):
    return read(spark, d, "orders").select("o_orderkey", dates.on_or_after("o_orderdate", "Fri").alias("air"))


@query("""WITH r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, min(o_orderkey) AS ok FROM orders GROUP BY 1,2 HAVING count(*)=1)
SELECT o.o_orderkey, r.ok FROM orders o JOIN r ON o.o_custkey=r.o_custkey AND CAST(o.o_orderdate AS DATE)=r.d""")
def q12_unique_candidate(spark, d):
    left = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return joins.unique_candidate(left, left.withColumnRenamed("o_orderkey", "ok"), ["o_custkey", "day"]).select("o_orderkey", "ok")


@query("""WITH k AS (SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR),'+' ORDER BY CAST(l_suppkey AS VARCHAR)) AS key FROM lineitem GROUP BY 1)
SELECT key, min(l_orderkey) AS l_orderkey FROM k GROUP BY 1 HAVING count(*)=1""")
def q13_setkey_join(spark, d):
    keyed = read(spark, d, "lineitem").groupBy("l_orderkey").agg(joins.set_key(F.collect_set(F.col("l_suppkey").cast("string")), "+").alias("key"))
    return keyed.groupBy("key").agg(F.min("l_orderkey").alias("l_orderkey"), F.count("*").alias("c")).where("c = 1").drop("c")


@query("""SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id=b.user_id AND a.event_type='error' AND b.event_type='purchase'
 AND b.ts>a.ts AND b.ts<=a.ts + INTERVAL 6 HOUR""")
def q14_range_join(spark, d):
    e = read(spark, d, "events")
    a = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("a_ts"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b"), F.col("ts").alias("b_ts"))
    return joins.range_join(a, b, ["user_id"], "a_ts", "b_ts", 6 * 3600).select("a", "b")


@query("""WITH old AS (SELECT doc_id, quality, toxic FROM labels), new AS (SELECT doc_id, 1 AS quality, CAST(length(lang) AS INTEGER) AS toxic FROM documents)
SELECT coalesce(o.doc_id,n.doc_id) AS doc_id, coalesce(o.quality,n.quality) AS quality, coalesce(o.toxic,n.toxic) AS toxic FROM old o FULL JOIN new n ON o.doc_id=n.doc_id""")
def q15_fill_null_upsert(spark, d):
    new = read(spark, d, "documents").select("doc_id", F.lit(1).alias("quality"), F.length("lang").alias("toxic"))
    return reconcile.fill_nulls(read(spark, d, "labels").select("doc_id", "quality", "toxic"), new, ["doc_id"])


@query("""WITH prior AS (SELECT p_partkey AS id, p_name||'/'||p_brand AS k FROM part WHERE p_type<>'PROMO' QUALIFY row_number() OVER (PARTITION BY k ORDER BY id)=1),
 cur AS (SELECT DISTINCT p_name||'/'||p_brand AS k FROM part), j AS (SELECT cur.k, prior.id FROM cur LEFT JOIN prior USING (k))
SELECT k, coalesce(id, (SELECT max(p_partkey) FROM part) + row_number() OVER (PARTITION BY id IS NULL ORDER BY k)) AS id FROM j""")
def q16_stable_ids(spark, d):
    part = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_name", "p_brand").alias("k"), "p_type")
    return reconcile.stable_ids(part, part.where("p_type <> 'PROMO'").drop("p_type"), ["k"], part.agg(F.max("id").alias("top")))


@query("""WITH g AS (SELECT y, s FROM range(1995,2003) t(y) CROSS JOIN (SELECT DISTINCT o_orderstatus s FROM orders)),
 c AS (SELECT year(o_orderdate) y, o_orderstatus s, count(*) n FROM orders GROUP BY 1,2)
SELECT g.y, g.s, coalesce(n,0) AS n FROM g LEFT JOIN c ON g.y=c.y AND g.s=c.s WHERE coalesce(n,0)<500""")
def q17_floor_gate(spark, d):
    orders = read(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderstatus").alias("s"))
    return gates.floor_problems(orders.groupBy("y", "s").agg(F.count("*").alias("n")), (1995, 2002), orders, "s", 500)


@query("""WITH v AS (SELECT c_custkey k,'bal' src FROM customer WHERE c_acctbal>5000 UNION ALL SELECT o_custkey,'urgent' FROM orders WHERE o_orderpriority='1-URGENT'
 UNION ALL SELECT o_custkey,'big' FROM orders WHERE o_totalprice>400000)
SELECT k, count(DISTINCT src) AS n FROM v GROUP BY 1 HAVING count(DISTINCT src)>=2""")
def q18_two_of_three(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    v = c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), F.lit("bal").alias("src"))
    v = v.unionByName(o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"), F.lit("urgent").alias("src")))
    v = v.unionByName(o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("k"), F.lit("big").alias("src")))
    return reconcile.confirmed(v, ["k"], "src")


@query("""SELECT p_name, p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name,p_brand ORDER BY p_partkey)=1""")
def q19_first_wins_dedupe(spark, d):
    return reconcile.first_wins(read(spark, d, "part").select("p_name", "p_brand", "p_partkey"), ["p_name", "p_brand"], ["p_partkey"])


@query(r"""WITH s AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name),'[^a-z0-9\s-]','','g'),'[\s-]+','-','g'),'-') AS base FROM part)
SELECT p_partkey, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM s""")
def q20_slug_suffix(spark, d):
    named = read(spark, d, "part").select("p_partkey", text.slugify("p_name").alias("base"))
    return timeline.suffixes(named, "base", ["p_partkey"]).select("p_partkey", "base", F.col("k").cast("long").alias("k"))


@query("""SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey,o_orderpriority,count(*) n,max(o_orderdate) d FROM orders GROUP BY 1,2)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC,d DESC,o_orderpriority DESC)=1""")
def q21_modal_spelling(spark, d):
    return rollup.most_common(read(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderdate")


@query("""WITH c AS (SELECT l_suppkey s,l_returnflag f,count(*) n FROM lineitem GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC,f) k FROM c)
SELECT a.s, CASE WHEN b.n IS NULL OR a.n>=2*b.n THEN a.f ELSE 'undecided' END AS f FROM r a LEFT JOIN r b ON a.s=b.s AND b.k=2 WHERE a.k=1""")
def q22_decisive_margin(spark, d):
    return rollup.decisive(read(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f")), "s", "f")


@query("""SELECT event_type, CAST(sum(CAST(json_extract_string(props,'$.k') AS INTEGER)) AS BIGINT) AS k FROM events GROUP BY 1""")
def q23_json_props(spark, d):
    return read(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p")).groupBy("event_type").agg(F.sum("p.k").alias("k"))


@query("""SELECT page_id, len(regexp_extract_all(html,'<a href="([^"]*)"',1)) AS n_links FROM pages""")
def q24_html_links(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit('<a href="[^"]*"')).cast("long").alias("n_links"))


@query("""SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR),' & ' ORDER BY l_linenumber,l_partkey) AS matchup FROM lineitem GROUP BY 1""")
def q25_search_index(spark, d):
    nested = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("m"))
    return nested.select("l_orderkey", F.array_join(F.transform("m", lambda x: x["l_partkey"].cast("string")), " & ").alias("matchup"))


@query("""SELECT 'no_label' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'no_doc', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def q26_anti_both_ways(spark, d):
    return joins.anti_both(read(spark, d, "documents"), read(spark, d, "labels"), ["doc_id"], "no_label", "no_doc").select("side", "doc_id")


@query("""SELECT c.conv_id, c.turn, p.role AS implied FROM conversations c JOIN conversations p ON p.conv_id=c.conv_id AND p.turn=c.turn-1
JOIN conversations n ON n.conv_id=c.conv_id AND n.turn=c.turn+1 WHERE p.role=n.role""")
def q27_neighbour_implied(spark, d):
    return timeline.neighbour_implied(read(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role").select("conv_id", "turn", "implied")


@query("""SELECT count(*) AS checked, count(*) FILTER (abs(l_discount-l_tax)>0.05) AS disagree FROM lineitem""")
def q28_agreement_gate(spark, d):
    return gates.agreement(read(spark, d, "lineitem"), F.col("l_discount"), F.col("l_tax"), 0.05)


# further shapes


@query("""SELECT o_orderkey, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ' & ' ORDER BY l_linenumber, l_partkey), '') AS parts, CAST(count(l_partkey) AS INTEGER) AS n
FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1""")
def q29_nest_join(spark, d):
    items = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    nested = cards.nest(read(spark, d, "orders").select("o_orderkey"), items, "o_orderkey", ["l_linenumber", "l_partkey"], "items")
    parts = F.array_join(F.transform("items", lambda x: x["l_partkey"].cast("string")), " & ")
    return nested.select("o_orderkey", parts.alias("parts"), F.size("items").alias("n"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS top, l_suppkey FROM lineitem)
SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_linenumber=top) AS mains, count(DISTINCT l_orderkey) AS events FROM w GROUP BY 1""")
def q30_main_events(spark, d):
    marked = rollup.main_events(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_orderkey", "l_linenumber")
    return marked.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if("is_main").alias("mains"), F.countDistinct("l_orderkey").alias("events"))


@query("""WITH e AS (SELECT user_id, event_id, CAST(ts AS DATE) AS d FROM events WHERE event_type='error'),
 p AS (SELECT user_id, CAST(ts AS DATE) AS d, min(event_id) AS pid FROM events WHERE event_type='purchase' GROUP BY 1,2)
SELECT e.event_id, (SELECT arg_min(pid, abs(date_diff('day', e.d, p.d))*2 + CASE WHEN p.d>e.d THEN 1 ELSE 0 END) FROM p WHERE p.user_id=e.user_id) AS nearest,
 CAST((SELECT min(abs(date_diff('day', e.d, p.d))) FROM p WHERE p.user_id=e.user_id) AS INTEGER) AS days FROM e""")
def q31_nearest_day(spark, d):
    e = read(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    rows = e.where("event_type = 'error'").select("user_id", "event_id", "day")
    entries = e.where("event_type = 'purchase'").groupBy("user_id", "day").agg(F.min("event_id").alias("pid")).withColumnRenamed("day", "pday")
    return joins.nearest(rows, entries, ["user_id"], "day", "pday", "pid", "event_id")


@query("""WITH p AS (SELECT user_id, ts, max(event_id) AS pid FROM events WHERE event_type='purchase' GROUP BY 1,2)
SELECT e.event_id, (SELECT arg_max(pid, ts) FROM p WHERE p.user_id=e.user_id AND p.ts<=e.ts) AS as_of FROM events e WHERE e.event_type='error'""")
def q32_as_of(spark, d):
    e = read(spark, d, "events")
    rows = e.where("event_type = 'error'").select("user_id", "event_id", "ts")
    entries = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("pid")).withColumnRenamed("ts", "pts")
    return joins.as_of(rows, entries, ["user_id"], "ts", "pts", "pid", "event_id")


@query("""SELECT (CAST(year(o_orderdate) AS INTEGER)//3)*3 AS era, count(*) AS n, CAST(sum(CAST(o_totalprice*100 AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1""")
def q33_era_shards(spark, d):
    o = read(spark, d, "orders").select(dates.era_start(F.year("o_orderdate")).alias("era"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return o.groupBy("era").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("""WITH a AS (SELECT l_orderkey k, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_custkey, o_orderstatus, s FROM orders JOIN a ON k=o_orderkey),
 b AS (SELECT x.o_orderkey AS a, y.o_orderkey AS b, len(list_intersect(x.s, y.s)) AS overlap FROM o x JOIN o y ON x.o_custkey=y.o_custkey AND x.o_orderstatus='F' AND y.o_orderstatus<>'F'),
 r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY overlap DESC) n, lead(overlap) OVER (PARTITION BY a ORDER BY overlap DESC) nx FROM b WHERE overlap>=1)
SELECT a, b, overlap FROM r WHERE n=1 AND (nx IS NULL OR nx<overlap)""")
def q34_overlap_join(spark, d):
    sets = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("s"))
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(sets, "o_orderkey")
    left = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("a"), "o_custkey", F.col("s").alias("sa"))
    right = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("b"), "o_custkey", F.col("s").alias("sb"))
    return joins.best_overlap(left, right, ["o_custkey"], "a", "b", "sa", "sb").select("a", "b", F.col("overlap").cast("long").alias("overlap"))


@query("""SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
WHERE c_acctbal > 0 GROUP BY 1,2""")
def q35_star_rollup(spark, d):
    c = read(spark, d, "customer").where("c_acctbal > 0").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select("n_name", "c_mktsegment", "n")


@query("""WITH p AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1,2)
SELECT a.o_custkey, a.d AS day, b.d AS other FROM p a JOIN p b ON a.o_custkey=b.o_custkey AND b.d<>a.d AND abs(date_diff('day', a.d, b.d))<=10""")
def q36_within_days(spark, d):
    days = read(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day")).distinct()
    return joins.within_days(days, days.withColumnRenamed("day", "other"), ["o_custkey"], "day", "other", 10).where("day <> other").select("o_custkey", "day", "other")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT o_custkey, o_orderkey, before FROM r WHERE o_orderstatus='P'""")
def q37_previous_holder(spark, d):
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return timeline.previous(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus", "before").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", "before")


@query("""WITH v AS (SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region)
SELECT name, count(*) AS n FROM v GROUP BY 1 HAVING count(*)>=1""")
def q38_union_sources(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return n.unionByName(r, allowMissingColumns=True).groupBy("name").agg(F.count("*").alias("n"))


@query("""SELECT 'before' AS side, l_orderkey, l_linenumber FROM lineitem WHERE l_tax > 0.07 EXCEPT ALL SELECT 'before', l_orderkey, l_linenumber FROM lineitem WHERE l_tax > 0.07 AND l_discount <= 0.09""")
def q39_fidelity_gate(spark, d):
    rows = read(spark, d, "lineitem").where("l_tax > 0.07")
    keep = ["l_orderkey", "l_linenumber", "l_quantity"]
    return reconcile.changed(rows.select(*keep), rows.where("l_discount <= 0.09").select(*keep), ["l_quantity"]).select("side", "l_orderkey", "l_linenumber")


@query("""SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE event_type IN ('error','purchase')
AND user_id NOT IN (SELECT user_id FROM events WHERE event_type='login') GROUP BY 1""")
def q40_anti_join_rollup(spark, d):
    e = read(spark, d, "events")
    rows = e.where(F.col("event_type").isin("error", "purchase")).join(e.where("event_type = 'login'").select("user_id"), "user_id", "left_anti")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
