"""Operator 8: removing repeated passages by a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (in a smaller document, or
before in the same one).  Suffixes are compared by prefix polynomial hashes: the common extension of two
suffixes is found by binary search over lengths, so a comparison costs log(LENGTH) hash look-ups; a
mergesort on such comparisons puts equal suffixes side by side, and neighbours that seem equal are
verified byte by byte.

Not every suffix of the corpus has to be sorted.  In each window of LENGTH bytes the least hash of its
``GRAM``-byte grams is its anchor (the leftmost of ties), so equal windows have equal anchors at equal
places.  Windows in a row with one anchor form a segment (about 37 bytes of text each).  Segments are
dealt by anchor hash: of segments with equal content only the first is new, all others are repeated in
full; content is told by the anchor's hash and an independent 64-bit hash of all bytes.  Only where
different segments share an anchor (the borders of passages) are the suffixes of their windows sorted.

Scale: a segment is a few numbers; one shuffle deals all of them, and the groups are streamed in order,
so an anchor with a third of all segments takes constant memory.  Before the shuffle each batch settles its own
repeated segments: all but the first of equal ones start later than it, and are dealt out evenly instead of by
their anchor.  Suffixes are sorted in bounded chunks of whole anchor groups.  A heavy group (more than
``GROUP`` different segments) is split by the longest gram there is, the whole window: its windows are dealt by
128-bit hash, again without those that a batch has settled, streamed in order and verified byte by byte.  Text
moves by document only, to fetch the bytes of unsettled segments and to cut the result.

Defined results: null text is empty.  Documents are ordered by doc_id (null first), and by a 64-bit hash of
their text where they share it; rows with the same doc_id and text are the same document and get the
same result.  An empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 100
GRAM = 28
GROUP = 20_000  # segments of some 136 bytes: a chunk of under 3 MB
_SPAN = LENGTH - GRAM + 1  # grams in a window
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.uint64((1 << 24) - 1)

KEY = "ord long, tie long"
SEGMENTS = f"h long, s long, {KEY}, p int, n int"


# polynomial hashes


class PrefixHash:
    """Hashes of any substring of a byte buffer, from prefix sums of byte * base**place (mod 2**64)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.power = _powers(_BASE, n + 1)
        self.inverse = _powers(_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def grams(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:-length]) * self.inverse[:n] if n > 0 else np.empty(0, np.uint64)


_power_cache: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1)."""
    held = _power_cache.get(int(base))
    if held is None or len(held) < n:
        held = np.ones(max(n, 1 << 12), np.uint64)
        held[1:] = base
        held = np.multiply.accumulate(held)
        _power_cache[int(base)] = held
    return held[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the weak low bits of polynomial hashes."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# segments


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, anchor hash) of the segments of the texts data[starts:ends].

    Texts lie in data one after the other; less than 2**24 bytes.
    """
    none = np.empty(0, np.int64)
    count = np.maximum(0, ends - starts - LENGTH + 1)
    if not count.sum():
        return none, none, none, none
    hashes = mixed(PrefixHash(data).grams(GRAM))
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    reach = 1
    while reach * 2 <= _SPAN:  # minima of windows of 2, 4, ... grams
        np.minimum(least[: len(least) - reach], least[reach:], out=least[: len(least) - reach])
        reach *= 2
    rest = _SPAN - reach
    least = np.minimum(least[: len(least) - rest], least[rest:])
    text = np.repeat(np.arange(len(starts)), count)
    first = np.cumsum(count) - count
    place = np.arange(len(text)) - first[text] + starts[text]
    anchor = (least[place] & _PLACE).astype(np.int64)
    cut = np.concatenate([[0], np.nonzero((np.diff(anchor) != 0) | (np.diff(text) != 0))[0] + 1])
    n = np.diff(np.concatenate([cut, [len(text)]]))
    return text[cut], place[cut], n, hashes[anchor[cut]].view(np.int64)


def _texts(batch: pa.RecordBatch, column: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a binary column: (bytes, row, start in bytes, end, the row's offset of the piece).

    Rows longer than ``most`` come in pieces that overlap by LENGTH - 1 bytes, so no window is lost.
    """
    array = batch.column(column)
    offsets = np.frombuffer(array.buffers()[1], np.int32 if pa.types.is_binary(array.type) else np.int64)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        if offsets[to] - offsets[at] <= most:
            lo, hi = offsets[at], offsets[to]
            yield data[lo:hi], np.arange(at, to), offsets[at:to] - lo, offsets[at + 1 : to + 1] - lo, np.zeros(to - at, np.int64)
        else:
            for lo in range(int(offsets[at]), int(offsets[to]), most):
                hi = min(int(offsets[to]), lo + most + LENGTH - 1)
                yield data[lo:hi], np.array([at]), np.array([0]), np.array([hi - lo]), np.array([lo - int(offsets[at])])
        at = to


def _emit(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _settled(key: np.ndarray, place: list[np.ndarray], same: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows that say nothing new, later rows): of rows with equal key and ``same`` columns the one of the least place is neither.

    Rows of the same place as it say nothing new; all others are later.
    """
    nothing, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    order = np.argsort(key, kind="stable")
    pair = key[order][1:] == key[order][:-1]
    twin = np.zeros(len(key), bool)
    twin[order[1:][pair]] = True
    twin[order[:-1][pair]] = True
    at = np.flatnonzero(twin)
    if len(at):
        columns = [c[at] for c in (*same, *place)]
        rank = np.lexsort(columns[::-1])
        at, columns = at[rank], [c[rank] for c in columns]
        group = np.any([np.diff(c) != 0 for c in columns[: len(same)]], axis=0)
        first = np.maximum.accumulate(np.concatenate([[0], np.where(group, np.arange(1, len(at)), 0)]))
        again = first < np.arange(len(at))
        equal = np.all([c == c[first] for c in columns[len(same) :]], axis=0)
        nothing[at[again & equal]] = True
        later[at[again & ~equal]] = True
    return nothing, later


def _elsewhere(*place: np.ndarray) -> np.ndarray:
    """A key that deals rows out evenly."""
    out = np.zeros(len(place[0]), np.uint64)
    for x in place:
        out = mixed(out ^ x.astype(np.int64).view(np.uint64))
    return out.view(np.int64)


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments; those that a batch has settled as repeated come with -n and a key that deals them out."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        ord_, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        found: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for data, row, start, end, base in _texts(batch, 2):
            text, place, n, h = segments(data, start, end)
            if not len(text):
                continue
            view = memoryview(np.ascontiguousarray(data))
            s = np.array([digest(view[a:b]) for a, b in zip(place.tolist(), (place + n + LENGTH - 1).tolist(), strict=True)], np.uint64).view(np.int64)
            own = row[text]
            for c, x in zip(found, (h, s, ord_[own], tie[own], (place - start[text] + base[text]).astype(np.int32), n.astype(np.int32)), strict=True):
                c.append(x)
        if found[0]:
            h, s, o, t, p, n = (np.concatenate(c) for c in found)
            nothing, later = _settled(h ^ s, [o, t, p], [h, s])
            h, n = np.where(later, _elsewhere(o, t, p), h), np.where(later, -n, n)
            yield _emit([x[~nothing] for x in (h, s, o, t, p, n)], ["h", "s", "ord", "tie", "p", "n"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of (h, s, ord, tie, p) -> kind 0: repeated in full; kind 1: first of its content, and others share its anchor."""
    last: tuple | None = None  # the last content's first row, and whether it was given out
    given = False
    for batch in batches:
        c = [x.to_numpy() for x in batch.columns]
        settled = c[5] < 0
        if settled.any():
            yield _emit([np.zeros(int(settled.sum()), np.int8), *(x[settled] for x in (c[0], c[2], c[3], c[4], -c[5]))], ["kind", "h", "ord", "tie", "p", "n"])
            c = [x[~settled] for x in c]
        size = len(c[0])
        if not size:
            continue
        new = np.ones(size, bool)
        new[1:] = (np.diff(c[0]) != 0) | (np.diff(c[1]) != 0)
        if last is not None:
            new[0] = (c[0][0], c[1][0]) != last[:2]
        first = np.maximum.accumulate(np.where(new, np.arange(size), -1))
        same = np.ones(size, bool)
        for k in (2, 3, 4):
            of_first = np.where(first >= 0, c[k][np.maximum(first, 0)], last[k] if last is not None else 0)
            same &= c[k] == of_first
        again = np.nonzero(~new & ~same)[0]
        if len(again):
            yield _emit([np.zeros(len(again), np.int8), *(x[again] for x in (c[0], c[2], c[3], c[4], c[5]))], ["kind", "h", "ord", "tie", "p", "n"])
        reps = np.nonzero(new)[0]
        if len(reps):
            rows = [x[reps] for x in c]
            if last is not None:
                rows = [np.concatenate([[v], x]).astype(x.dtype) for v, x in zip(last, rows, strict=True)]
            shared = np.zeros(len(rows[0]), bool)
            pair = rows[0][1:] == rows[0][:-1]
            shared[1:] |= pair
            shared[:-1] |= pair
            if given:
                shared[0] = False  # it is out already
            at = np.nonzero(shared)[0]
            if len(at):
                yield _emit([np.ones(len(at), np.int8), *(x[at] for x in (rows[0], rows[2], rows[3], rows[4], rows[5]))], ["kind", "h", "ord", "tie", "p", "n"])
            given = bool(shared[-1]) or (len(rows[0]) == 1 and given)
            last = tuple(x[-1] for x in rows)


# suffix sort


class SuffixSort:
    """Sorts suffixes of a buffer by their first LENGTH bytes, by hashed comparisons."""

    def __init__(self, data: np.ndarray):
        self.data, self.hash = data, PrefixHash(data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, at most LENGTH, by binary search."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), LENGTH)
        while True:
            open_ = np.nonzero(lo < hi)[0]
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_] + 1) // 2
            equal = self.hash.of(a[open_], mid) == self.hash.of(b[open_], mid)
            lo[open_] = np.where(equal, mid, lo[open_])
            hi[open_] = np.where(equal, hi[open_], mid - 1)

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b; of equal ones the one that starts first."""
        n = self.common(a, b)
        differ = n < LENGTH
        k = np.minimum(n, LENGTH - 1)
        return np.where(differ, self.data[a + k] < self.data[b + k], a < b)

    def sort(self, places: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mergesort of the suffixes at places, ascending within ascending buckets; all merges of a level at once."""
        places = places.copy()
        n, width = len(places), 1
        starts = np.searchsorted(bucket, bucket, "left")
        ends = np.searchsorted(bucket, bucket, "right")
        rank = np.arange(n) - starts
        most = int((ends - starts).max(initial=0))
        while width < most:
            run = rank // width
            left = run % 2 == 0
            own = starts + run * width
            other_lo = np.where(left, own + width, own - width)
            other_hi = np.minimum(other_lo + width, ends)
            other_lo = np.minimum(other_lo, ends)
            lo, hi = other_lo.copy(), other_hi.copy()
            while True:  # how many of the other run come before each suffix
                open_ = np.nonzero(lo < hi)[0]
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                less = self.before(places[mid], places[open_])
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
            pair = np.where(left, own, own - width)
            to = pair + (np.arange(n) - own) + (lo - other_lo)
            merged = np.empty_like(places)
            merged[to] = places
            places, width = merged, width * 2
        return places, bucket


def repeated(data: np.ndarray, places: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The places (ascending, in ascending buckets) whose first LENGTH bytes start earlier in their bucket.

    Suffixes whose hash of LENGTH bytes is unique in the bucket have no equal and are not sorted.
    """
    sorter = SuffixSort(data)
    hashed = mixed(sorter.hash.of(places, LENGTH)) ^ mixed(bucket.astype(np.uint64) + np.uint64(1))
    order = np.argsort(hashed, kind="stable")
    twin = np.zeros(len(places), bool)
    pair = hashed[order][1:] == hashed[order][:-1]
    twin[order[1:][pair]] = True
    twin[order[:-1][pair]] = True
    places, bucket = places[twin], bucket[twin]
    if not len(places):
        return places
    ranked, of = sorter.sort(places, bucket)
    equal = (sorter.common(ranked[1:], ranked[:-1]) == LENGTH) & (of[1:] == of[:-1])
    at = np.nonzero(equal)[0]
    window = np.arange(LENGTH)
    for lo in range(0, len(at), 20_000):  # collision verification
        k = at[lo : lo + 20_000]
        if (data[ranked[k + 1][:, None] + window] != data[ranked[k][:, None] + window]).any():
            return _by_bytes(data, places, bucket)
    return np.sort(ranked[1:][equal])


def _by_bytes(data: np.ndarray, places: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The same from the bytes alone, for a chunk in which two hashes collided."""
    seen: set[tuple[int, bytes]] = set()
    out = []
    for p, b in zip(places.tolist(), bucket.tolist(), strict=True):
        key = (b, data[p : p + LENGTH].tobytes())
        if key in seen:
            out.append(p)
        seen.add(key)
    return np.array(out, np.int64)


def _sorted_groups(batches: Iterator[pa.RecordBatch], chunk_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Unsettled segments with their bytes, in order of (h, ord, tie, p) -> repeated runs of windows: ord, tie, p, n."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = [r for i, r in enumerate(rows) if not i or r[:4] != rows[i - 1][:4]]
        data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        n = np.array([r[4] for r in rows])
        base = np.cumsum([0, *(len(r[5]) for r in rows)])[:-1]
        row = np.repeat(np.arange(len(rows)), n)
        places = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + base[row]
        h = np.array([r[0] for r in rows])
        bucket = np.cumsum(np.concatenate([[0], np.diff(h) != 0]))[row]
        found = repeated(data, places, bucket)
        if len(found):
            of = np.searchsorted(base, found, "right") - 1
            cut = np.concatenate([[0], np.nonzero((np.diff(found) != 1) | (np.diff(of) != 0))[0] + 1])
            size = np.diff(np.concatenate([cut, [len(found)]]))
            own = of[cut]
            first = found[cut] - base[own]
            yield _emit([np.array([rows[i][1] for i in own], np.int64), np.array([rows[i][2] for i in own], np.int64), np.array([rows[i][3] for i in own], np.int32) + first.astype(np.int32), size.astype(np.int32)], ["ord", "tie", "p", "n"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= chunk_bytes and held[-1][0] != r[0]:
                yield from settle(held)
                held, size = [], 0
            held.append(r)
            size += len(r[5])
    if held:
        yield from settle(held)


_WINDOWS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ord", pa.int64()), ("tie", pa.int64()), ("p", pa.int32()), ("body", pa.binary())])


def _window_rows(batches: Iterator[pa.RecordBatch], rows: int = 40_000) -> Iterator[pa.RecordBatch]:
    """Segments of heavy groups -> a row for each window, with a hash of 128 bits; windows settled in a batch are dealt out, without bytes."""
    digest = xxhash.xxh3_128_digest

    def windows(held: list[tuple]) -> pa.RecordBatch:
        bodies = [r[5][i : i + LENGTH] for r in held for i in range(r[4])]
        n = np.array([r[4] for r in held])
        pair = np.frombuffer(b"".join(map(digest, bodies)), "<i8").reshape(-1, 2)
        o, t = (np.repeat(np.array([r[k] for r in held], np.int64), n) for k in (1, 2))
        p = np.concatenate([np.arange(r[3], r[3] + r[4], dtype=np.int32) for r in held])
        a, b = pair[:, 0].copy(), pair[:, 1].copy()
        nothing, later = _settled(a ^ b, [o, t, p], [a, b])
        a = np.where(later, _elsewhere(o, t, p), a)
        keep = np.flatnonzero(~nothing)
        body = pa.array(bodies, pa.binary(), mask=later).take(pa.array(keep))
        return pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in (a, b, o, t, p)), body], schema=_WINDOWS)

    held, size = [], 0
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(r)
            size += r[4]
            if size >= rows:
                yield windows(held)
                held, size = [], 0
    if held:
        yield windows(held)


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order of (a, b, ord, tie, p) -> those that are not the first of their bytes; equal hashes are verified."""
    last: tuple | None = None
    firsts: dict[bytes, tuple] = {}
    for batch in batches:
        rows = []
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[5] is None:
                rows.append((*r[2:5], 1))
                continue
            if last is None or r[:2] != last:
                last, firsts = r[:2], {}
            first = firsts.setdefault(r[5], r[2:5])
            if first != r[2:5]:
                rows.append((*r[2:5], 1))
        if rows:
            c = list(zip(*rows, strict=True))
            yield _emit([np.array(c[0], np.int64), np.array(c[1], np.int64), np.array(c[2], np.int32), np.array(c[3], np.int32)], ["ord", "tie", "p", "n"])


# the operator


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ord, tie, text, wanted segments -> the segments with their bytes."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for ord_, tie, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            body = text.as_buffer()
            for w in wanted:
                for c, v in zip(out, (w["h"], ord_, tie, w["p"], w["n"], body.slice(w["p"], w["n"] + LENGTH - 1).to_pybytes()), strict=True):
                    c.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["h", "ord", "tie", "p", "n", "body"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, runs of repeated windows -> the result."""
    for batch in batches:
        rows = []
        for doc_id, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            body = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            spans: list[list[int]] = []
            for a, b in sorted((r["p"], r["p"] + r["n"] + LENGTH - 1) for r in runs or ()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(body[at:a])
                at = b
            kept.update(body[at:])
            rows.append((doc_id, len(body), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        if rows:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in RESULT.split(", ")[:5]] + ["spans"])


def _let_go(spark) -> None:
    """Shuffle files of finished steps go when the driver has collected its garbage; disk is short here."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_runs(keyed: DataFrame) -> DataFrame:
    """ord, tie, p, n: runs of windows that start earlier too, of texts (ord, tie, body)."""
    spark = keyed.sparkSession
    rows = keyed.where(F.octet_length("body") >= LENGTH).select("ord", "tie", "body").mapInArrow(_segment_rows, SEGMENTS)
    split = common.materialize(rows.repartition("h").sortWithinPartitions("h", "s", "ord", "tie", "p").mapInArrow(_split, f"kind byte, h long, {KEY}, p int, n int"), "segments", by=["kind"])
    del rows
    _let_go(spark)
    full = split.where("kind = 0").select("ord", "tie", "p", "n")
    wanted = split.where("kind = 1").groupBy("ord", "tie").agg(F.collect_set(F.struct("h", "p", "n")).alias("wanted"))
    bodies = common.materialize(keyed.select("ord", "tie", "body").join(wanted, ["ord", "tie"]).select("ord", "tie", "body", "wanted").mapInArrow(_contexts, f"h long, {KEY}, p int, n int, body binary"), "contexts")
    _let_go(spark)
    large = common.materialize(split.where("kind = 1").groupBy("h").count().where(F.col("count") > GROUP).select("h"), "heavy")
    has_large = not large.isEmpty()
    small = bodies.join(large, "h", "left_anti") if has_large else bodies
    order = ["h", "ord", "tie", "p"]
    out = full.unionByName(small.select(*order, "n", "body").repartition("h").sortWithinPartitions(*order).mapInArrow(_sorted_groups, f"{KEY}, p int, n int"))
    if has_large:
        windows = bodies.join(large, "h", "left_semi").select(*order, "n", "body").mapInArrow(_window_rows, f"a long, b long, {KEY}, p int, body binary")
        out = out.unionByName(windows.repartition("a", "b").sortWithinPartitions("a", "b", "ord", "tie", "p").mapInArrow(_later_windows, f"{KEY}, p int, n int"))
    return out


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of documents (doc_id, text)."""
    keyed = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("ord"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    runs = common.settled(documents.sparkSession, lambda: repeated_runs(keyed).groupBy("ord", "tie").agg(F.collect_set(F.struct("p", "n")).alias("runs")), "runs")
    _let_go(documents.sparkSession)
    return keyed.join(runs, ["ord", "tie"], "left").select("doc_id", "body", "runs").mapInArrow(_cut, RESULT)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The query: what is left of every document."""
    return dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")
