"""Readers: tables, JSON in pages, shards, markdown and text listings, rulings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import gates


def tables(spark: SparkSession, folder: str, *names: str, columns: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Parquet tables of a folder, each with only the columns asked for."""
    out = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    return {n: df.select(*columns[n]) if columns and n in columns else df for n, df in out.items()}


def embedded_json(spark: SparkSession, path: str, schema: str, element: str = "data") -> DataFrame:
    """The JSON in a page's <script id="..."> element, ``<\\/`` unescaped."""
    pages = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", rf'(?s)<script[^>]*id="{element}"[^>]*>(.*?)</script>', 1)
    return pages.select(F.from_json(F.replace(body, F.lit("<\\/"), F.lit("</")), schema).alias("data")).select("data.*")


def with_shards(core: DataFrame, shards: DataFrame, key: str = "event_id") -> DataFrame:
    """Core rows with what was split out of them; a core row without its shard fails the job."""
    out = core.join(shards, key, "left")
    heavy = [c for c in shards.columns if c != key]
    return out.withColumn(key, F.when(F.col(heavy[0]).isNotNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no shard for "), F.col(key).cast("string")))))


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that is there, by the cluster's file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(conf).exists(where):
            return p
    raise FileNotFoundError(", ".join(paths))


def histories(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON histories of one schema; missing files are left out."""
    found = []
    for p in paths:
        try:
            found.append(first_existing(spark, [p]))
        except FileNotFoundError:
            continue
    return spark.read.schema(schema).json(found, multiLine=True).withColumn("file", F.input_file_name()) if found else spark.createDataFrame([], schema).withColumn("file", F.lit(None).cast("string"))


def lines(df: DataFrame, column: str = "value") -> DataFrame:
    """line_no, line of every text, empty lines left out."""
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.posexplode(F.split(column, r"\r?\n")).alias("line_no", "line")).where(F.trim("line") != "")


def markdown_rows(df: DataFrame, columns: list[str], column: str = "value") -> DataFrame:
    """Rows of markdown tables as trimmed columns; head and rule rows are left out."""
    rows = lines(df, column).where(F.col("line").rlike(r"^\s*\|") & ~F.col("line").rlike(r"^\s*\|[\s:|-]+\|?\s*$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    out = rows.withColumn("_c", cells).where(F.size("_c") >= len(columns))
    keep = [c for c in df.columns if c != column]
    out = out.select(*keep, "line_no", *(F.col("_c")[i].alias(n) for i, n in enumerate(columns)))
    return out.where(F.lower(columns[0]) != columns[0].lower())


def link_text(c: Column | str) -> Column:
    """[label](url) to its label."""
    return F.regexp_replace(text.col(c), r"\[([^\]]*)\]\([^)]*\)", "$1")


def link_number(c: Column | str, parameter: str = "nr") -> Column:
    """The number in a link's query."""
    return F.regexp_extract(text.col(c), rf"[?&]{parameter}=(\d+)", 1).try_cast("long")


def rated_matches(pages: DataFrame) -> DataFrame:
    """air_date, fixture, sides, won, stars, rating, votes of rated-match tables (date, fixture, won rating, rating, votes)."""
    r = markdown_rows(pages, ["Date", "Match", "WON", "Rating", "Votes"])
    return r.select(dates.day_first("Date").alias("air_date"), link_text("Match").alias("fixture"), text.sides(link_text("Match")).alias("sides"), F.col("WON").alias("won"), dates.stars("WON").alias("stars"), F.col("Rating").try_cast("double").alias("rating"), F.col("Votes").try_cast("int").alias("votes"))


def promos(pages: DataFrame) -> DataFrame:
    """nr, air_date, title, workers, rating, votes; of repeated numbers the first line stays."""
    r = markdown_rows(pages, ["Date", "Promo", "Workers", "Rating", "Votes"])
    r = r.select(link_number("Promo").alias("nr"), dates.day_first("Date").alias("air_date"), link_text("Promo").alias("title"), F.filter(F.split(link_text("Workers"), r"\s*,\s*"), lambda w: w != "").alias("workers"), F.col("Rating").try_cast("double").alias("rating"), F.col("Votes").try_cast("int").alias("votes"), "line_no")
    from ..operators.reconcile import first_wins

    return first_wins(r, ["nr"], ["line_no"]).drop("line_no")


def feuds(pages: DataFrame) -> DataFrame:
    """matchup, start, end (YYYY-MM), rating, votes."""
    r = markdown_rows(pages, ["Time", "Feud", "Rating", "Votes"])
    return r.select(link_text("Feud").alias("matchup"), dates.month_span("Time").alias("s"), F.col("Rating").try_cast("double").alias("rating"), F.col("Votes").try_cast("int").alias("votes")).select("matchup", "s.start", "s.end", "rating", "votes").where("start IS NOT NULL")


def tournaments(pages: DataFrame) -> DataFrame:
    """air_date, title, winners; undated rows are left out."""
    r = markdown_rows(pages, ["Date", "Tournament", "Winner"])
    winners = F.transform(F.regexp_extract_all("Winner", F.lit(r"\[([^\]]*)\]\("), F.lit(1)), lambda x: F.trim(x))
    return r.select(dates.day_first("Date").alias("air_date"), link_text("Tournament").alias("title"), winners.alias("winners")).where("air_date IS NOT NULL")


def title_reigns(pages: DataFrame) -> DataFrame:
    """nr, champions, start, end, days of title tables ("DD.MM.YYYY - DD.MM.YYYY" or "today")."""
    r = markdown_rows(pages, ["No", "Champion", "Dates", "Days"])
    part = lambda i: F.trim(F.try_element_at(F.split("Dates", r"\s+-\s+"), F.lit(i)))
    return r.select(F.col("No").try_cast("int").alias("nr"), text.members(link_text("Champion")).alias("champions"), dates.day_first(part(1)).alias("start"), dates.day_first(part(2)).alias("end"), dates.digits("Days").alias("days"))


def listing(pages: DataFrame) -> DataFrame:
    """air_date, nr, title, place, workers of event listings: one line holds an event and links of workers."""
    rows = lines(pages).where(F.col("line").rlike(r"\d{2}\.\d{2}\.\d{4}") & F.col("line").contains("id=1&nr="))
    worker = F.transform(F.regexp_extract_all("line", F.lit(r"\[([^\]]*)\]\([^)]*id=2&nr=\d+[^)]*\)"), F.lit(1)), lambda x: F.trim(x))
    return rows.select(dates.day_first(F.regexp_extract("line", r"(\d{2}\.\d{2}\.\d{4})", 1)).alias("air_date"), F.regexp_extract("line", r"id=1&nr=(\d+)", 1).cast("long").alias("nr"), F.regexp_extract("line", r"\[([^\]]*)\]\([^)]*id=1&nr=", 1).alias("title"), F.trim(F.regexp_extract("line", r"@\s*([^|\[]+)", 1)).alias("place"), worker.alias("workers"))


def pair_lines(pages: DataFrame, order: list[str]) -> DataFrame:
    """name, day: a name line and the line after it, which is a date (M/D/YYYY, D.M.YYYY or in words)."""
    from pyspark.sql import Window

    rows = lines(pages)
    keys = [c for c in pages.columns if c != "value"] or [F.lit(0)]
    nxt = rows.withColumn("_next", F.lead("line").over(Window.partitionBy(*keys).orderBy(*order)))
    name = F.trim(F.regexp_replace("line", r"^\s*(?:\d+[.)]|[-*])\s*", ""))
    return nxt.select(name.alias("name"), dates.any_date("_next").alias("day"), "line_no").where("day IS NOT NULL")


def rulings(spark: SparkSession, path: str) -> DataFrame:
    """class, event, match, prefix of a CSV with a header."""
    return spark.read.csv(path, header=True, schema="class string, event long, match int, prefix string, ruling string").select("class", "event", "match", "prefix")


def har_images(spark: SparkSession, path: str) -> DataFrame:
    """url, mime, body of the images in HAR files."""
    schema = "log struct<entries array<struct<request struct<url string>, response struct<content struct<mimeType string, text string, encoding string>>>>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("log.entries").alias("e"))
    c = "e.response.content"
    return e.where(F.col(f"{c}.mimeType").startswith("image/") & (F.col(f"{c}.encoding") == "base64")).select(F.col("e.request.url").alias("url"), F.col(f"{c}.mimeType").alias("mime"), F.unbase64(f"{c}.text").alias("body"))


def first_captures(captures: DataFrame, day: Column, days_after: int) -> DataFrame:
    """url, ts: the first capture of each address from the day on, within so many days."""
    near = captures.where((F.to_date("ts") >= day) & (F.to_date("ts") <= F.date_add(day, days_after)))
    return near.groupBy("url").agg(F.min("ts").alias("ts"))


def check_references(t: dict[str, DataFrame]) -> None:
    """Fails if a match, team or participant has no parent, before anything is built on them."""
    for child, parent, key in (("matches", "events", "event_id"), ("match_teams", "matches", "match_id"), ("match_participants", "match_teams", "team_id")):
        if child in t and parent in t:
            gates.require_empty(gates.orphans(t[child], t[parent], key), f"{child} without {parent}")
