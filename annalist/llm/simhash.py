"""Operator 10: SimHash near-dedup through a segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments of two bits, and a segment is embedded as its bit
count (0 to 2).  The Manhattan distance of two count vectors never exceeds the Hamming distance of the
fingerprints.  If two fingerprints differ in at most 3 bits, their vectors differ by at most 1 in one
of the two halves (16 segments each), so a grid with one cell for each count vector of a half is
range-joined with radius 1: a fingerprint lies in its own cell and is a guest in the cells one step
up.  Within a cell, total bit counts (a Manhattan distance again) prune, and what is left is verified
by XOR and bit count.  Nothing is capped: every pair within 3 bits shares a cell.

Scale: only distinct fingerprints enter the grid (exact copies meet in one aggregate), 34 small rows
each.  A cell emits a spanning forest of its links instead of all pairs.  Components are found by
star rounds over those links; links, components and fingerprints never reach the driver.

Defined results: null text counts as empty; a text without words has fingerprint zero, linked like
any other.  component_id is the least doc_id of the component (nulls are passed over; null if there
is no other).  Repeated rows give repeated results.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordcache
from .graph import stars

SHINGLE = 3
SEED = 42
RADIUS = 3

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The SimHash of all word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    if n == 1:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)])
    rows = np.frombuffer(digests, dtype=np.uint8).reshape(n, 8)
    if n < 200:
        counts = np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(rows[:, j], minlength=256) @ _BITS_OF_BYTE for j in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(documents: DataFrame) -> DataFrame:
    """All columns but text, and fp: the fingerprint as a signed long."""
    others = [f for f in documents.schema if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordcache.release()
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(len(others))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(fp)], [*(f.name for f in others), "fp"])

    return documents.select(*(F.col(f"`{f.name}`") for f in others), "text").mapInArrow(run, schema)


def grid(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, guest, row) of every entry: own cells of both halves, and the cells one step up."""
    counts = fps - ((fps >> np.uint64(1)) & np.uint64(0x5555555555555555))
    cells, guests, rows = [], [], []
    for half in range(2):
        own = (counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        top = np.uint64(half << 32)
        cells.append(own | top)
        guests.append(np.zeros(len(fps), np.int8))
        rows.append(np.arange(len(fps)))
        for i in range(16):
            can = np.nonzero(((own >> np.uint64(2 * i)) & np.uint64(3)) < 2)[0]
            cells.append((own[can] + (np.uint64(1) << np.uint64(2 * i))) | top)
            guests.append(np.ones(len(can), np.int8))
            rows.append(can)
    return np.concatenate(cells).view(np.int64), np.concatenate(guests), np.concatenate(rows)


def cell_links(fps: np.ndarray, guest: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links of one cell (not those between two guests)."""
    total = np.bitwise_count(fps)
    order = np.argsort(total, kind="stable")
    fps, guest, total = fps[order], guest[order], total[order].astype(np.int64)
    group = np.arange(len(fps))
    lo, hi = np.searchsorted(total, total - RADIUS, "left"), np.searchsorted(total, total + RADIUS, "right")
    out = []
    for i in np.nonzero(guest == 0)[0]:
        near = slice(lo[i], hi[i])
        hits = np.nonzero((np.bitwise_count(fps[near] ^ fps[i]) <= RADIUS) & (group[near] != group[i]))[0] + lo[i]
        if len(hits):
            groups, first = np.unique(group[hits], return_index=True)
            out += [(int(fps[i]), int(fps[j])) for j in hits[first]]
            group[np.isin(group, groups)] = group[i]
    return out


def _links(batches: Iterator[pa.RecordBatch], small: int = 12) -> Iterator[pa.RecordBatch]:
    """Entries sorted by cell -> links.  Small cells go together in array operations, large ones alone."""

    def of(cell: np.ndarray, guest: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.concatenate([[0], np.nonzero(np.diff(cell))[0] + 1, [len(cell)]])
        size = np.diff(edges)
        sizes = np.repeat(size, size)
        a, b = [], []
        for s in range(1, small):
            i = np.nonzero((sizes[:-s] <= small) & (cell[:-s] == cell[s:]) & ((guest[:-s] & guest[s:]) == 0))[0]
            i = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= RADIUS]
            a.append(fp[i])
            b.append(fp[i + s])
        for k in np.nonzero(size > small)[0]:
            got = cell_links(fp[edges[k] : edges[k + 1]], guest[edges[k] : edges[k + 1]])
            if got:
                a.append(np.array([x for x, _ in got], np.uint64))
                b.append(np.array([y for _, y in got], np.uint64))
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        new = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
        if not len(new[0]):
            continue
        change = np.nonzero(np.diff(new[0]))[0]
        if held and held[-1][0][-1] != new[0][0]:
            cut = 0
        elif not len(change):
            held.append(new)
            continue
        else:
            cut = change[0] + 1 if held else 0
        if held:
            yield from of(*(np.concatenate(c) for c in zip(*held, tuple(x[:cut] for x in new), strict=True)))
            new = tuple(x[cut:] for x in new)
        last = change[-1] + 1 - cut if len(change) and change[-1] + 1 > cut else 0
        if last:
            yield from of(*(x[:last] for x in new))
        held = [tuple(x[last:] for x in new)]
    if held:
        yield from of(*(np.concatenate(c) for c in zip(*held, strict=True)))


def links(distinct: DataFrame) -> DataFrame:
    """a, b: links that connect whatever fingerprints (column fp, distinct) lie within 3 bits."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            cell, guest, row = grid(fps)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(guest), pa.array(fps[row].view(np.int64))], ["cell", "guest", "fp"])

    entries = distinct.select("fp").mapInArrow(spread, "cell long, guest byte, fp long")
    return entries.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links, "a long, b long")


def clusters(marked: DataFrame) -> DataFrame:
    """fp, root of every distinct fingerprint; marked has column fp."""

    def build() -> DataFrame:
        distinct = common.materialize(marked.groupBy("fp").agg(F.count("*").alias("copies")), "fingerprints")
        found = stars(links(distinct))
        return distinct.join(found, distinct.fp == found.a, "left").select("fp", F.coalesce("b", "fp").alias("root"))

    return common.settled(marked.sparkSession, build, "clusters")


def op10_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """The query: every document's fingerprint and component."""
    marked = common.materialize(fingerprints(common.table(spark, sf_dir, "documents").select("doc_id", "text")), "simhash")
    least = common.materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("m")).join(clusters(marked), "fp"), "roots")
    named = common.materialize(least.groupBy("root").agg(F.min("m").alias("component_id")), "named")
    ids = common.materialize(least.select("fp", "root").join(named, "root").select("fp", "component_id"), "components")
    return marked.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the least doc_id stays (null last, then by content; of repeated rows, one).

    Null text counts as empty; an empty table stays empty.  Rows are told apart by a 128-bit hash of all their
    columns, so extra columns may have any name but those of common.KEYS.
    """
    common.bounded_batches(spark)
    keys = common.KEYS
    keyed = docs.select("*", *common.row_key(docs))
    marked = common.materialize(fingerprints(keyed.select("doc_id", "text", *keys)), "simhash")
    first = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *keys)).alias("s"))
    kept = common.materialize(first.join(clusters(marked), "fp").groupBy("root").agg(F.min("s").alias("s")).select(*(F.col(f"s.{k}").alias(k) for k in keys)), "kept")
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).select(*(F.col(f"`{c}`") for c in docs.columns))
