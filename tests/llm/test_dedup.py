import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from annalist.llm import graph, queries, simhash
from annalist.llm import suffix_dedup as sd

# SimHash


def plain_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "A b c", "a b c d\te\nF", "É ab\x1cc d e", "x y z " * 3000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(fps ^ fps[i]) <= 3)[0]:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def clustered(seed, centres, each):
    rng = np.random.default_rng(seed)
    out = [0]
    for c in rng.integers(0, 2**64, centres, dtype=np.uint64):
        for _ in range(each):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    return np.unique(np.array(out, np.uint64))


def test_cell_links_connect_what_is_near():
    fps = clustered(1, 3, 60)
    got = simhash.cell_links(fps, np.zeros(len(fps), np.int8))
    assert all(bin(a ^ b).count("1") <= 3 for a, b in got) and len(got) < len(fps)
    place = {int(f): i for i, f in enumerate(fps)}
    root = list(range(len(fps)))
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in got:
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == plain_components(fps)


def test_every_near_pair_shares_a_cell():
    fps = clustered(2, 40, 2)
    cell, guest, row = simhash.grid(fps)
    held = {}
    for c, g, r in zip(cell, guest, row, strict=True):
        held.setdefault(int(c), []).append((int(g), int(r)))
    met = {(a, b) for m in held.values() for x, a in m for y, b in m if not (x and y)}
    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(fps ^ fps[i]) <= 3)[0]:
            assert (i, int(j)) in met


def test_clusters_on_spark(spark):
    fps = np.concatenate([clustered(5, 12, 40), clustered(6, 200, 2)])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)] * 2, "fp long")
    got = {r.fp: r.root for r in simhash.clusters(df).collect()}
    fps = np.unique(fps)
    want = plain_components(fps)
    groups = {}
    for f, w in zip(fps.view(np.int64), want, strict=True):
        groups.setdefault(w, set()).add(got[int(f)])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(61)} == {0} and {got[1000 + i] for i in range(300)} == {1000}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


DOC = "doc_id long, text string, lang string, source string, fp int"


def test_stage_keeps_one_of_each_group(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog again and again " * 20
    rows = [(5, text, None, None, 1), (3, text, "x", None, 1), (3, text, "x", None, 1), (9, None, None, None, 1), (8, "", None, None, 1), (None, "other words here " * 9, None, None, 1)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "d"))
    out = simhash.stage(spark, spark.read.parquet(str(tmp_path / "d")), "")
    assert out.columns == [c.split()[0] for c in DOC.split(", ")]
    assert sorted((r.doc_id or -1, r.lang) for r in out.collect()) == [(-1, None), (3, "x"), (8, None)]
    assert simhash.stage(spark, spark.read.parquet(str(tmp_path / "d")).limit(0), "").count() == 0


def test_op10(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op10_simhash_dedup"](spark, sf).collect()}
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    fps = np.array([plain_fingerprint(t) for _, t in docs], np.uint64)
    roots = plain_components(fps)
    for (i, _), f, r in zip(docs, fps, roots, strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{f:016x}", docs[r][0])


# repeated passages


def brute(docs):
    seen, out = set(), []
    for i, text in docs:
        b = (text or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                mark[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        out.append((i, len(b), sum(mark), len([s for s in bytes(mark).split(b"\0") if s]), hashlib.sha256(kept).hexdigest()))
    return out


def planted(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdef gh\né") for _ in range(n))
    shared = [prose(n) for n in (99, 100, 101, 150, 400, 1000)]
    docs = []
    for i in range(40):
        parts = [prose(rng.randint(0, 300)) for _ in range(3)]
        for s in rng.sample(shared, 3):
            a = rng.randint(0, len(s) // 3)
            parts.insert(rng.randint(0, 3), s[a:])
        docs.append((i, "".join(parts)))
    docs += [(50, docs[0][1]), (51, docs[0][1] + "x"), (52, "a" * 5000), (53, "ab" * 900), (54, "a" * 150), (55, None), (56, ""), (57, "z" * 99), (58, shared[5] * 3)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # large groups take the path by window hash
        monkeypatch.setattr(sd, "GROUP", 2)
    docs = planted(seed)
    df = spark.createDataFrame([(i, t, "c") for i, t in docs][::-1], "doc_id long, text string, body string").repartition(3)
    assert sorted(tuple(r)[:5] for r in sd.dedup(df).collect()) == brute(docs)


@pytest.mark.parametrize("group", [1, 2000])
def test_one_passage_in_every_document(spark, group, monkeypatch):
    monkeypatch.setattr(sd, "GROUP", group)
    rng = random.Random(7)
    prose = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    hot = prose(260)
    docs = [(i, prose(rng.randint(0, 150)) + hot + prose(rng.randint(0, 150))) for i in range(250)] + [(300 + i, hot * 2) for i in range(60)]
    df = spark.createDataFrame(docs[::-1], "doc_id long, text string").repartition(7)
    assert sorted(tuple(r)[:5] for r in sd.dedup(df).collect()) == brute(docs)


def test_settled_rows_are_those_after_the_first():
    key, place = np.array([7, 7, 5, 7, 7, 9], np.int64), [np.array([3, 1, 1, 1, 2, 0]), np.array([0, 4, 0, 4, 0, 0])]
    nothing, later = sd._settled(key, place, [key])
    assert later.tolist() == [True, False, False, False, True, False] and sorted(nothing[[1, 3]].tolist()) == [False, True]
    assert not sd._settled(key, place, [np.arange(6)])[1].any()  # equal keys of different content


def test_equal_window_hashes_are_verified():
    import pyarrow as pa

    rows = [(1, 1, 0, 0, 5, b"x"), (1, 1, 0, 0, 6, b"y"), (1, 1, 2, 0, 0, b"x"), (1, 2, 3, 0, 0, b"x"), (4, 0, 9, 0, 9, None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), sd._WINDOWS, strict=True)], schema=sd._WINDOWS)
    assert [r for b in sd._later_windows(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] == [(2, 0, 0, 1), (9, 0, 9, 1)]


def test_repeated_rows_nulls_and_no_rows(spark):
    rng = random.Random(4)
    t = "".join(rng.choice("abcdefgh ") for _ in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in sd.dedup(df).collect())
    assert got == [(0, 0), (1, 300), (1, 300), (2, 300)]
    assert sd.dedup(df.limit(0)).count() == 0


def test_suffix_sort_orders_like_bytes():
    rng = random.Random(9)
    block = bytes(rng.choice(b"ab") for _ in range(130))
    data = np.frombuffer(block + block[:120] + bytes(rng.choice(b"ab") for _ in range(150)) + block, np.uint8)
    places = np.arange(len(data) - 99)
    got, _ = sd.SuffixSort(data).sort(places, np.zeros(len(places), np.int64))
    assert list(got) == sorted(places, key=lambda p: (data[p : p + 100].tobytes(), p))
    found = sd.repeated(data, places, np.zeros(len(places), np.int64))
    assert list(found) == list(sd._by_bytes(data, places, np.zeros(len(places), np.int64))) and len(found)


def test_long_rows_are_cut_into_overlapping_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd._texts, "__defaults__", (700,))
    docs = planted(3)[30:]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r)[:5] for r in sd.dedup(df).collect()) == brute(docs)


def test_op8(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, queries.QUERIES["op8_suffix_dedup"](spark, sf).collect())) == brute(docs)
