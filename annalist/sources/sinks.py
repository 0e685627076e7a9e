"""Writers: era shards, sidecars, review files and pages.  Directories go through Spark's commit protocol."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text


def write_sharded(events: DataFrame, path: str, heavy: str = "matches", key: str = "event_id", day: str = "air_date", width: int = 3) -> None:
    """The heavy column by era of ``width`` years under path/shards, then the rest under path/core.

    Shards first, so that a reader of the core always finds them; eras that are gone do not stay.
    """
    shards = events.select(key, heavy, dates.era_start(F.year(day), width).alias("era"))
    shards.repartition("era", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("era").parquet(f"{path}/shards")
    events.drop(heavy).write.mode("overwrite").parquet(f"{path}/core")


def write_sidecar(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def review_csv(rows: DataFrame, path: str, fields: list[str], order: list[str]) -> None:
    """One sorted CSV file of the given fields; for reports, which are small by nature."""
    rows.select(*fields).orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_tsv(rows: DataFrame, path: str) -> None:
    strings = {f.name for f in rows.schema if f.dataType.simpleString() == "string"}
    rows.select(*(text.clean_cell(c).alias(c) if c in strings else F.col(c) for c in rows.columns)).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def atomic_write(path: str, content: str) -> None:
    """A local text file by a temporary file beside it and a rename."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(content)
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)


def inject(template: str, data: str, mark: str = "/*DATA*/") -> str:
    """A page with JSON in a script element, ``</`` escaped; the mark must be there once."""
    if template.count(mark) != 1:
        raise ValueError("the template needs its mark once")
    return template.replace(mark, data.replace("</", "<\\/"))


def report(rows: DataFrame, keys: list[str], title: str) -> str:
    """A markdown table of counts."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys).collect()
    head = [f"# {title}", "", f"| {' | '.join([*keys, 'n'])} |", "|" + "---|" * (len(keys) + 1)]
    return "\n".join([*head, *(f"| {' | '.join(str(x) for x in r)} |" for r in found), ""])
