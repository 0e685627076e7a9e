"""Operator 4: best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces: only documents longer than a sequence are cut, and whole-sequence
pieces stand alone.  The rest is bin packing.  Pieces are dealt to shards of about ``SHARD`` pieces.
Islands evolve each shard's packing from best-fit packings in decreasing and in random order: crossover injects
whole well-filled bins of one parent into another, drops the bins that hold duplicates of their pieces,
and best-fits the displaced pieces; mutation empties the worst bins.  Each island is a task; its elite
migrates to the next island after a round, until a packing reaches the lower bound (the tokens divided by the
sequence length, rounded up) or the rounds are over.  Then the poorly filled bins of all shards are opened
and their pieces go to the next level, with ``FAN`` times fewer shards, until one shard is left, so at
most the last shard has an open bin of its own.

Scale: state is a few small numbers a piece, never token ids; a task holds one shard.  The driver sees
counts only.

Defined results: null text is empty (one token, the end id).  Repeated rows are packed one by one.
An empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .wordcache import pieces_of, tokenizer

LENGTH = 4096
END = 1
SHARD = 4096
FAN = 16
ISLANDS = 2
ROUNDS = 2
GENERATIONS = 8
FULL = 0.99  # bins below this share are opened for the next level

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(documents: DataFrame, path: str, end: int = END, length: int = LENGTH) -> DataFrame:
    """The token pieces of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path, keeps_space=False)
        for batch in batches:
            for at, texts in pieces_of(batch.column(1)):
                flat, sizes = encoder.encode(texts)
                flat, sizes = np.insert(flat, np.cumsum(sizes), end).astype("<u4"), sizes + 1
                cuts = -(-sizes // length)
                doc = np.repeat(np.arange(len(sizes)), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * length
                size = np.minimum(length, sizes[doc] - start)
                lo = (np.cumsum(sizes) - sizes)[doc] + start
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(lo.tolist(), (lo + size).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())], [f.split()[0] for f in PIECES.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class Packing:
    """Bins of item numbers."""

    def __init__(self, bins: list[list[int]], fills: list[int]):
        self.bins, self.fills = bins, fills

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then unevenly filled ones."""
        return -len(self.bins), sum((f / capacity) ** 2 for f in self.fills)


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]], fills: list[int], order: dict[int, float] | None = None) -> Packing:
    """Adds items, largest first (or in the given order), each to the fullest bin that takes it."""
    free = sorted((capacity - f, b) for b, f in enumerate(fills) if f < capacity)
    for i in sorted(items, key=(lambda i: (-sizes[i], i)) if order is None else order.__getitem__):
        s = sizes[i]
        k = bisect_left(free, (s, -1))
        if k == len(free):
            bins.append([i])
            fills.append(s)
            if s < capacity:
                insort(free, (capacity - s, len(bins) - 1))
        else:
            left, b = free.pop(k)
            bins[b].append(i)
            fills[b] += s
            if left > s:
                insort(free, (left - s, b))
    return Packing(bins, fills)


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Injects whole well-filled bins of b into a."""
    ranked = sorted(range(len(b.bins)), key=lambda k: (-b.fills[k], rng.random()))
    some = ranked[: max(1, len(ranked) // 2)]
    chosen = rng.sample(some, rng.randint(1, max(1, len(some) // 2)))
    inside = {i for k in chosen for i in b.bins[k]}
    bins, fills, displaced = [list(b.bins[k]) for k in chosen], [b.fills[k] for k in chosen], []
    for own, f in zip(a.bins, a.fills, strict=True):
        if inside.isdisjoint(own):
            bins.append(list(own))
            fills.append(f)
        else:
            displaced += [i for i in own if i not in inside]
    return best_fit(displaced, sizes, capacity, bins, fills)


def mutate(a: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Empties the least filled bins and a few others, and packs their items again."""
    ranked = sorted(range(len(a.bins)), key=lambda k: (a.fills[k], k))
    out = set(ranked[: 2 + len(ranked) // 50]) | set(rng.sample(ranked, min(len(ranked), 3)))
    items = [i for k in out for i in a.bins[k]]
    rng.shuffle(items)
    bins, fills = [list(a.bins[k]) for k in range(len(a.bins)) if k not in out], [a.fills[k] for k in range(len(a.bins)) if k not in out]
    half = len(items) // 3
    first = best_fit(items[:half], sizes, capacity, bins, fills)
    return best_fit(items[half:], sizes, capacity, first.bins, first.fills)


def evolve(population: list[Packing], sizes: list[int], capacity: int, rng: random.Random, generations: int = GENERATIONS, members: int = 4) -> list[Packing]:
    """The fittest packings after some generations (one at least); stops at the lower bound.

    The first of the population that is missing is packed best-fit decreasing, others best-fit in random order.
    """
    bound = -(-sum(sizes) // capacity)
    rank = lambda p: p.fitness(capacity)
    items = list(range(len(sizes)))
    while len(population) < members:
        drawn = None if not population else {i: rng.random() for i in items}
        population = [*population, best_fit(items, sizes, capacity, [], [], drawn)]
    for _ in range(generations):
        population = sorted(population, key=rank, reverse=True)[:members]
        children = []
        for _ in range(members // 2):
            a, b = rng.sample(population, 2)
            children += [crossover(a, b, sizes, capacity, rng), crossover(b, a, sizes, capacity, rng)]
        population = sorted([*population, *children, mutate(population[0], sizes, capacity, rng)], key=rank, reverse=True)
        if len(population[0].bins) <= bound:
            break
    return population


def _packing(pdf: pd.DataFrame) -> Packing:
    """The packing that a frame's column ``bin`` tells, over its row numbers."""
    bins: dict[int, list[int]] = {}
    sizes = pdf["length"].tolist()
    for i, b in enumerate(pdf["bin"].tolist()):
        bins.setdefault(b, []).append(i)
    return Packing(list(bins.values()), [sum(sizes[i] for i in b) for b in bins.values()])


def _bin_column(p: Packing, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for b, items in enumerate(p.bins):
        out[items] = b
    return out


ITEMS = "item long, length long, shard long, bin long"
ELITES = "item long, length long, shard long, bin long, island int, origin int, optimal boolean"


def _island(capacity: int, round_: int):
    """The task of an island in one round: it evolves its own elite and those that came in (none in the first round)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        members = [m.sort_values("item").reset_index(drop=True) for _, m in pdf.groupby("origin", sort=True)]
        sizes = members[0]["length"].tolist()
        best = evolve([_packing(m) for m in members] if round_ else [], sizes, capacity, random.Random(shard * 1000 + island * 10 + round_))[0]
        optimal = len(best.bins) <= -(-sum(sizes) // capacity)
        return members[0].assign(bin=_bin_column(best, len(sizes)), island=island, origin=island, optimal=optimal)[["item", "length", "shard", "bin", "island", "origin", "optimal"]]

    return run


def _fittest(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    members = [m.sort_values("item").reset_index(drop=True) for _, m in pdf.groupby("origin", sort=True)]
    best = max(members, key=lambda m: _packing(m).fitness(capacity))
    return best[["item", "length", "shard", "bin"]]


def pack_shards(items: DataFrame, shards: int, capacity: int = LENGTH) -> DataFrame:
    """item, length, shard, bin of items (item, length), each shard packed for itself by its islands."""
    dealt = items.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard"), F.lit(0).cast("long").alias("bin"))
    islands = F.explode(F.array(*(F.lit(i) for i in range(ISLANDS))))
    elites = dealt.withColumn("island", islands).withColumn("origin", F.lit(0)).withColumn("optimal", F.lit(False))
    finished = None
    for r in range(ROUNDS):
        evolved = common.materialize(elites.groupBy("shard", "island").applyInPandas(_island(capacity, r), ELITES), f"elites{r}")
        if r == ROUNDS - 1:
            finished = evolved if finished is None else finished.unionByName(evolved)
            break
        marked = evolved.join(evolved.groupBy("shard").agg(F.max("optimal").alias("done")), "shard")
        closed, rest = marked.where("done").drop("done"), marked.where("not done").drop("done")
        finished = closed if finished is None else finished.unionByName(closed)
        if rest.isEmpty():
            break
        elites = rest.unionByName(rest.withColumn("island", (F.col("island") + 1) % ISLANDS))  # migration
    return common.materialize(finished.groupBy("shard").applyInPandas(lambda pdf: _fittest(pdf, capacity), ITEMS), "shards")


def pack(items: DataFrame, capacity: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """item, length, sequence_id, offset of items (item, length at most capacity; item unique)."""
    spark = items.sparkSession
    whole = items.where(F.col("length") >= capacity).select("item", "length", (F.col("item") + F.lit(1 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity)
    n, level, settled = rest.count(), 0, []
    shards = max(1, -(-n // shard))
    while n:

        def build(rest=rest, shards=shards) -> DataFrame:
            packed = pack_shards(rest, shards, capacity)
            fill = packed.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
            done = fill.where((F.col("fill") >= FULL * capacity) if shards > 1 else F.lit(True))
            return packed.join(done.select("shard", "bin", F.lit(True).alias("kept")), ["shard", "bin"], "left")

        sequence = (F.lit(level << 54) + F.col("shard") * F.lit(1 << 22) + F.col("bin")).alias("sequence_id")
        marked = common.settled(spark, build, f"level{level}")
        settled.append(marked.where("kept").select("item", "length", sequence))
        if shards == 1:
            break
        rest = marked.where("kept is null").select("item", "length")
        left = rest.count()
        shards, level = max(1, min(-(-shards // FAN), -(-left // shard))), level + 1
        n = left
    out = spark.createDataFrame([], "item long, length long, sequence_id long, offset long")
    for s in settled:
        before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
        out = out.unionByName(s.withColumn("offset", before.cast("long")))
    return out.unionByName(whole)


def pack_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of documents (doc_id, text)."""
    cut = common.materialize(pieces(documents, path or vocabulary()).withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack(cut.select("item", "length"))
    return cut.join(placed.select("item", "sequence_id", "offset"), "item").drop("item")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The query: all documents in sequences of at most 4096 tokens."""
    return pack_documents(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: where each piece of each document stands, a row for each piece.

    Null text counts as empty (the end id alone), repeated rows are packed one by one, an empty table gives no rows;
    only doc_id and text are read, so other columns may have any name.
    """
    common.bounded_batches(spark)
    return pack_documents(docs.select("doc_id", "text"))
