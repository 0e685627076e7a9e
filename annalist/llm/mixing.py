"""Operator 9: mixing sources to target weights by cube-method balanced sampling.

A document's expected number of copies is its source's ratio of target to size.  The whole part is
taken outright; the fraction is an inclusion probability.  The cube method turns the probabilities
into 0 or 1 without losing the totals: the flight phase moves the probabilities of a few documents at
a time along the null space of the balancing constraints (document total and token total), until one
of them is 0 or 1, and goes on with the next; so each block keeps both totals exactly and leaves at
most two fractional documents.  The landing problem is what is left when a source has one block: the
rounding of those few that misses both totals least.

Scale: documents meet in blocks of about ``block`` rows of one source (a hash of their place), each
flown by a task of its own (blocks are dealt by a hash of the row and its repetition, so a repeated row is split too); what each block leaves (at most two rows) goes to the next level, with
``block`` times fewer rows, until every source has one block.  Only ids, sizes and probabilities move.

Where rows have a stratum (the pipeline's stage: their language), the first level's blocks are of one stratum of a
source, so the mix keeps both totals of every stratum up to what its blocks leave; the next levels join the strata.

Targets: sources by code point, null last, weigh 1, 2, 3 and so on again; they share all sizes by
weight, no source above ``most`` times its own size, and what is cut off is shared among the others by
weight until none is above.

Blocks and draws follow from the rows' content, not from how the input is split, so reruns agree.

Defined results: null text has size 0; documents of size 0 count as documents and take 0 words.  A
source of size 0 has target 0.  Repeated rows are drawn one by one.  An empty table
gives no rows; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

import zlib
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

EPS = 1e-9


def word_count(text: str = "text"):
    """Number of maximal runs outside the white space U+0020 and U+0009 to U+000D; null: 0."""
    spaced = F.translate(F.col(text), "\t\n\x0b\x0c\r", "     ")
    words = F.regexp_count(spaced, F.lit("[^ ]+"))
    return F.coalesce(words, F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, rows, target of sources (source, source_size, rows): shares by weight, none above ``most`` times its size.

    Sources are numbered by sorted ranges and offsets.  A source is capped where the level (what is left, per
    weight) passes ``most`` times its size per weight; the level only rises as more are capped, so each round
    takes two sums over all sources, until no further one is capped.
    """
    spark = sources.sparkSession
    order = [F.col("source").asc_nulls_last()]
    dealt = sources.repartitionByRange(max(1, min(64, int(spark.conf.get("spark.sql.shuffle.partitions")))), *order).sortWithinPartitions(*order)
    placed = common.materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r.part, before))
        before += r["count"]
    starts = spark.createDataFrame(offsets, "part long, first long")
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    weighed = placed.join(F.broadcast(starts), part == F.col("part")).select("source", "source_size", "rows", F.get(kinds, F.pmod(place + F.col("first"), F.lit(len(weights))).cast("int")).alias("weight"))
    weighed = common.materialize(weighed, "weights")
    cap = F.lit(float(most)) * F.col("source_size")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    capped, level, shared, last = F.lit(False), None, None, -1
    while True:
        r = weighed.agg(F.count_if(capped).alias("n"), F.sum(F.when(capped, F.col("source_size"))).alias("size"), F.sum(F.when(~capped, F.col("weight"))).alias("weight")).first()
        if r.n == last or not r.weight:
            break
        last, level, shared = r.n, float(total - most * (r["size"] or 0)), r.weight
        share = F.lit(level) * F.col("weight") / F.lit(shared)
        capped = share > cap
    target = cap if level is None else F.when(capped, cap).otherwise(share)
    return common.materialize(weighed.select("source", "source_size", "rows", target.alias("target")), "targets")


def fly(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase over one block: probabilities move until at most two are fractional."""
    p = pi.astype(float).tolist()
    x = (size / max(1.0, size.mean())).tolist() if len(size) else []
    draws = rng.random(len(p) + 8)
    window: list[int] = []
    at, step = 0, 0
    n = len(p)
    while True:
        while len(window) < 3 and at < n:
            if EPS < p[at] < 1 - EPS:
                window.append(at)
            else:
                p[at] = float(round(p[at]))
            at += 1
        if len(window) < 3:
            return np.array(p)
        a, b, c = window
        # the null space of [[1, 1, 1], [x_a, x_b, x_c]]
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, d in zip(window, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        move = up if draws[step % len(draws)] * (up + down) < down else -down
        step += 1
        for i, d in zip(window, u, strict=True):
            p[i] += move * d
            if p[i] < EPS or p[i] > 1 - EPS:
                p[i] = float(round(p[i]))
        window = [i for i in window if 0 < p[i] < 1]


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The landing phase: rounds the few fractional ones so that words, then documents, miss least.

    Where a very long document is among them, rounding alone may miss by half its length; then at most
    two documents that the flight has settled in the same block are turned over to make up for it.
    """
    open_ = np.nonzero((pi > EPS) & (pi < 1 - EPS))[0]
    out = np.round(pi)
    if not len(open_):
        return out
    words, docs = float(pi[open_] @ size[open_]), float(pi[open_].sum())
    out[open_] = min(product((0.0, 1.0), repeat=len(open_)), key=lambda r: (abs(float(np.dot(r, size[open_])) - words), abs(sum(r) - docs), r))
    miss = float(out[open_] @ size[open_]) - words
    settled = np.setdiff1d(np.arange(len(pi)), open_)
    change = (1 - 2 * out[settled]) * size[settled]
    order = np.argsort(change, kind="stable")
    change, settled = change[order], settled[order]
    best, turned = abs(miss), ()
    for i, c in enumerate([0.0, *change]):
        k = int(np.searchsorted(change, -miss - c))
        for j in (k - 1, k, k + 1):
            if 0 <= j < len(change) and j != i - 1 and abs(miss + c + change[j]) < best - 0.5:
                best, turned = abs(miss + c + change[j]), (j,) if i == 0 else (i - 1, j)
    for j in turned:
        out[settled[j]] = 1 - out[settled[j]]
    return out


def _flight(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    source, stratum, block, level, last = key
    pdf = pdf.sort_values(["size", "doc_id", *common.KEYS, "nth"], kind="stable").reset_index(drop=True)
    place = f"{source}|{block}|{level}" + (f"|{stratum}" if isinstance(stratum, str) else "")
    seed = zlib.crc32(place.encode("utf-8", "surrogatepass"))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(pdf))
    pdf = pdf.iloc[order].reset_index(drop=True)
    pi, size = pdf["pi"].to_numpy(), pdf["size"].to_numpy().astype(float)
    pi = fly(pi, size, rng)
    pdf["pi"] = land(pi, size) if last else pi
    return pdf


FLOWN = f"{common.KEYS[0]} long, {common.KEYS[1]} long, nth long, doc_id long, source string, stratum string, size long, source_size long, target double, sure long, pi double, blocks long"


def draw(documents: DataFrame, weights: tuple = (1, 2, 3), most: int = 3, block: int = 4096) -> DataFrame:
    """The columns of common.KEYS, doc_id, source, size, source_size, target, copies: a row for every row of documents.

    documents: doc_id, source, size, maybe stratum, and the columns of common.KEYS, which tell different rows apart (rows
    that share them are repeated ones and are drawn one by one).  copies: how often the mix takes the document.
    """
    return common.settled(documents.sparkSession, lambda: _draw(documents, weights, most, block), "draw")


def _draw(documents: DataFrame, weights: tuple, most: int, block: int) -> DataFrame:
    spark, keys = documents.sparkSession, common.KEYS
    stratum = F.col("stratum") if "stratum" in documents.columns else F.lit(None)
    rows = documents.select(*keys, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), stratum.cast("string").alias("stratum"), F.col("size").cast("long").alias("size"))
    base = common.materialize(rows.groupBy(*keys, "doc_id", "source", "stratum", "size").agg(F.count("*").alias("n")), "sizes")
    strata = common.materialize(base.groupBy("source", "stratum").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.ceil(F.sum("n") / block).cast("long").alias("rows")), "strata")
    sums = strata.groupBy("source").agg(F.sum("source_size").alias("source_size"), F.sum("rows").alias("rows"))  # rows: of blocks
    plans = common.settled(spark, lambda: targets(sums, weights, most), "plans")
    same = lambda x, y, *names: reduce(lambda c, n: c & F.col(f"{x}.{n}").eqNullSafe(F.col(f"{y}.{n}")), names, F.lit(True))
    planned = strata.alias("s").join(plans.alias("p"), same("s", "p", "source")).select("s.source", "s.stratum", F.col("s.rows").alias("within"), F.col("p.rows").alias("blocks"), "p.source_size", "p.target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sure = F.floor(ratio + EPS)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth")
    known = base.alias("d").join(planned.alias("p"), same("d", "p", "source", "stratum")).select(*keys, each, "doc_id", "d.source", "d.stratum", "size", "source_size", "target", sure.cast("long").alias("sure"), F.greatest(F.lit(0.0), ratio - sure).alias("pi"), "blocks", "within")
    names = [f.split()[0] for f in FLOWN.split(", ")]
    done, current, level = None, known, 0
    fractional = lambda df: df.where((F.col("pi") > EPS) & (F.col("pi") < 1 - EPS))
    whole = lambda df: df.where((F.col("pi") <= EPS) | (F.col("pi") >= 1 - EPS))
    most_blocks = plans.agg(F.max("rows")).first()[0] or 0
    while True:
        keyed = fractional(current).withColumn("b", F.pmod(F.xxhash64(*keys, "nth", F.lit(level)), F.col("blocks" if level else "within"))).withColumn("level", F.lit(level)).withColumn("last", F.col("blocks") == 1)
        flown = keyed.groupBy("source", "stratum", "b", "level", "last").applyInPandas(lambda key, pdf: _flight(key, pdf)[names], FLOWN)
        out = common.materialize(whole(current).select(names).unionByName(flown), f"flight{level}")
        done = whole(out) if done is None else done.unionByName(whole(out))
        if most_blocks <= 1:
            break
        current = fractional(out).withColumn("stratum", F.lit(None).cast("string")).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("blocks") * 2 / block)).cast("long"))
        most_blocks, level = max(1, -(-most_blocks * 2 // block)), level + 1
    copies = F.col("sure") + F.round("pi").cast("long")
    return done.select(*keys, "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(documents: DataFrame) -> DataFrame:
    """The draw over documents (doc_id, text, source)."""
    return draw(documents.select(*common.row_key(documents, ["doc_id", "text", "source"]), "doc_id", "source", word_count().alias("size")))


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The query: what the mix takes of every document."""
    got = mix(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document stands in the output as often as the mix takes it (0 to 3 times).

    Null text has size 0, null source is a source of its own, repeated rows are drawn one by one, an empty table
    stays empty.  Where there is a column lang, a source's words are taken in the shares of its languages (null is one).  Rows are told apart by a 128-bit hash of all their columns, so extra columns may have any name
    but those of common.KEYS.  What is taken grows with the documents, so the join is a merge at every size.
    """
    common.bounded_batches(spark)
    keys, n = common.KEYS, "_annalist_copies"
    language = F.col("lang") if "lang" in docs.columns else F.lit(None)
    keyed = docs.select("*", *common.row_key(docs))
    taken = draw(keyed.select(*keys, "doc_id", "source", language.alias("stratum"), word_count().alias("size"))).groupBy(*keys).agg(F.sum("copies").alias(n)).where(F.col(n) > 0)
    once = keyed.join(taken.hint("merge"), keys).dropDuplicates(keys)
    return once.withColumn("_annalist_copy", F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*(F.col(f"`{c}`") for c in docs.columns))
