"""Operator 1: exact top-k search by columnar branch-and-bound.

Vectors are integers.  A block of candidates is laid out vertically (one contiguous row per
dimension).  For each query, inner products are accumulated dimension block by dimension block; after
each block a candidate survives only if its partial score plus the bound on the mass that remains
(Cauchy-Schwarz over the dimensions still to come) can reach the query's current k-th score, and the
survivors are compacted.  The result is exact at every magnitude: bounds are rounded up, in integers
where doubles would not do, and ties survive.

Scale: the query set is read in groups of about ``group`` vectors, whose size is what is sent to
the executors; each group is one pass over all candidates as they lie, and only k rows a query and task
are shuffled.

Defined results: vectors that are null, empty, or hold null or non-finite components, or one whose integer
does not fit a long, take no part.  Vectors of different lengths are not compared.  A candidate with the
query's own vec_id is the query itself.  Candidates are rows: one that is repeated is found as often.  Equal
query rows count once; different vectors of one query vec_id are searched each and share its ranks.  Scores
beyond a long count as the nearest long.  An empty table gives no rows.  Rows with a null vec_id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCHEMA = "query_id long, vec_id long, score long"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantize(vectors: DataFrame, vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component as long; unusable vectors are left out."""
    x = F.col(vector)
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * F.lit(scale)) < F.lit(2.0**63)))
    return vectors.where(usable & F.col("vec_id").isNotNull()).select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("long")).alias("v"))


def _matrix(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the row numbers, and the vectors as rows."""
    offsets = column.offsets.to_numpy()
    lengths, flat = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(lengths):
        rows = np.nonzero(lengths == d)[0]
        out[int(d)] = rows, flat[(offsets[rows][:, None] + np.arange(d)[None, :])]
    return out


class BlockSearch:
    """The k best candidates of each query among the blocks seen so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, step: int = 16):
        self.ids, self.q, self.k, self.step = ids, queries, k, step
        d = queries.shape[1]
        self.cuts = list(range(0, d, step)) + [d]
        self.rest = self._rest(queries)
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)

    def _rest(self, m: np.ndarray) -> np.ndarray:
        """Norms of what remains after each dimension block, rounded up."""
        f = m.astype(np.float64)
        mass = np.stack([np.sqrt((f[:, c:] ** 2).sum(axis=1)) for c in self.cuts[1:]], axis=1)
        return mass * (1 + 1e-9)

    @staticmethod
    def _bound(partial: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """partial + rest, rounded up: both exact in the kind of numbers at hand."""
        if partial.dtype == np.float64:
            return partial + (rest + 1)  # below 2**53, where a sum is off by less than 1
        more = np.ceil(rest * (1 + 1e-9)) + 1
        return partial + (more.astype(np.int64) if partial.dtype == np.int64 else np.array([int(x) for x in more], dtype=object))

    def add(self, ids: np.ndarray, block: np.ndarray) -> None:
        most = float(np.abs(block.astype(np.float64)).max(initial=0)) * float(np.abs(self.q.astype(np.float64)).max(initial=0)) * block.shape[1]
        kind = np.float64 if most < 2**50 else np.int64 if most < 2**60 else object
        vertical = np.ascontiguousarray(block.T).astype(kind)
        queries, rest = self.q.astype(kind), self._rest(block)
        for n, own in enumerate(self.ids):
            scores, found = self.best[n]
            floor = scores[-1] if len(scores) == self.k else None
            if floor is not None and floor == _LEAST:
                floor = None  # scores below a long tie with it
            alive, partial = None, 0
            for b, (lo, hi) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
                part = vertical[lo:hi] if alive is None else vertical[lo:hi, alive]
                partial = partial + queries[n, lo:hi] @ part
                if floor is not None:
                    bound = self._bound(partial, self.rest[n, b] * (rest[:, b] if alive is None else rest[alive, b]))
                    keep = np.nonzero(bound >= (int(floor) if kind is object else floor))[0]
                    if len(keep) < len(bound):
                        alive, partial = keep if alive is None else alive[keep], partial[keep]
                        if not len(alive):
                            break
            got = ids if alive is None else ids[alive]
            if not len(got):
                continue
            partial = np.array([min(max(int(x), _LEAST), _MOST) for x in partial], np.int64) if kind is object else np.asarray(partial).astype(np.int64)
            other = got != own
            scores, found = np.concatenate([scores, partial[other]]), np.concatenate([found, got[other]])
            order = np.lexsort((found, ~scores))[: self.k]
            self.best[n] = scores[order], found[order]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for own, (scores, found) in zip(self.ids, self.best, strict=True):
            yield from ((int(own), int(v), int(s)) for s, v in zip(scores, found, strict=True))


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, group: int = 16_384, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the largest integer inner product.

    queries, candidates: (vec_id, v array<long>), as quantize() returns them.
    """
    spark = candidates.sparkSession
    asked = common.materialize(queries.select("vec_id", "v").distinct(), "queries")
    n = asked.count()
    rows = spark.createDataFrame([], SCHEMA)
    groups = max(1, -(-n // group))
    of = F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups))
    for g in range(groups if n else 0):
        held: dict[int, tuple[list, list]] = {}
        for r in asked.where(of == g).orderBy("vec_id", "v").toLocalIterator():
            ids, vectors = held.setdefault(len(r.v), ([], []))
            ids.append(r.vec_id)
            vectors.append(r.v)
        sent = spark.sparkContext.broadcast({d: (np.array(i, np.int64), np.array(v, np.int64)) for d, (i, v) in held.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searches = {d: BlockSearch(i, v, k) for d, (i, v) in sent.value.items()}
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for d, (at, m) in _matrix(batch.column(1)).items():
                    for lo in range(0, len(at), block) if d in searches else ():
                        searches[d].add(ids[at[lo : lo + block]], m[lo : lo + block])
            for s in searches.values():
                got = list(s.rows())
                for lo in range(0, len(got), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got[lo : lo + 50_000], strict=True)], ["query_id", "vec_id", "score"])

        rows = rows.unionByName(candidates.select("vec_id", "v").mapInArrow(run, SCHEMA))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark, sf_dir: str) -> DataFrame:
    """The query: vec_id divisible by 50 against every row."""
    vectors = quantize(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return search(vectors.where(F.col("vec_id") % 50 == 0), vectors)
