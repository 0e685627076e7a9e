import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from annalist.llm import common, mixing, packing, queries, token_store, wordcache
from annalist.llm import secret_scan as scan
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# secrets


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "") if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(out)


TEXTS = [None, "", "password=hunter2x", 'API_KEY: "abcd1234efgh"', "secret: token: abcdefghijk", "ſecret=12345678", "toKen=12345678", "AKIAAKIA" + "X" * 9, "AKIA12345678901", "f" * 31 + " " + "0" * 32, 'token = "' + "0123456789abcdef" * 2 + '"', "passwd = 'short'", "é token=abcdefgh1 " * 2000]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert scan.base_spans(text or "") == plain_base(text)


@pytest.fixture(scope="module")
def model():
    return scan.train([])


def test_crf_finds_new_secrets_and_leaves_the_rest(model):
    scanner, hits, misses, wrong = scan.Scanner(model), 0, 0, 0
    for text, spans in scan._synthetic(seed=77, each=15):
        got = [(s, e) for s, _, e in scanner.spans(text)]
        found = sum(any(a < e and s < b for a, b in got) for s, e in spans)
        hits, misses = hits + found, misses + len(spans) - found
        wrong += sum(not any(a < e and s < b for s, e in spans) for a, b in got)
    assert hits >= 0.95 * (hits + misses) and wrong <= 3


SHORT = ["pwd = Hunter2xyz9", "passphrase: Tr0ub4dor3x", "Authorization: Bearer aBcDeFgHiJkLmNoPqRsTuVwXyZaBcD"]


@pytest.mark.parametrize("text", SHORT)
def test_short_and_digitless_secrets_are_found(model, text):
    start = text.rindex(" ") + 1
    assert scan.Scanner(model).spans(f"some words\n{text}\nother words") == [(11 + start, 3, 11 + len(text))]


def test_key_blocks_are_found_whole(model):
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    pick = lambda more, n: "".join(rng.choice(letters + more) for _ in range(n))
    whole = 0
    for _ in range(20):
        body = "\n".join([pick("0123456789+/", 64), pick("", 64), pick("0123456789+/", 64), pick("", 64), pick("0123", rng.randint(5, 30)) + "=="])
        text = f"words before\n-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----\nwords behind"
        whole += scan.Scanner(model).spans(text) == [(text.index(body), 3, text.index(body) + len(body))]
    assert whole >= 19


def test_cut_chains_decode_as_whole_ones(model):
    texts = [t for t, _ in scan._synthetic(seed=5, each=4)] + SHORT + ["", "\x1c a\u3000b é+ß= ǅ7 " * 3, "\0a b\0 " + "x" * 300]
    texts.append(" ".join(texts))
    tokens, labels = scan.Tokens(texts), []
    for text in texts:
        spans = scan.admitted(text)
        for chain in scan.runs(text, spans):
            labels.append((chain, len(labels)))
    assert [(s, e) for c, _ in labels for s, e in c] == list(zip(tokens.start.tolist(), tokens.end.tolist(), strict=True))
    assert np.flatnonzero(tokens.first).tolist() == np.cumsum([0, *(len(c) for c, _ in labels)])[:-1].tolist()
    rows, at, kept = tokens.rows(), 0, model.open(tokens)
    assert kept.mean() < 0.5
    for chain, _ in labels:
        path = np.array(model.viterbi(rows[at : at + len(chain)]))
        assert not (path[~kept[at : at + len(chain)]] > 0).any()
        at += len(chain)


def test_viterbi_equals_enumeration(model):
    from itertools import product

    text = "-----BEGIN KEY-----\n" + "\n".join("Ab1+" * 8 for _ in range(4))
    chain = scan.runs(text, scan.admitted(text))[0]
    f = [scan.features(text, chain, k, []) for k in range(len(chain))]
    s, t = model.scores(f), model.step + model.forbidden
    total = lambda y: s[0][y[0]] + model.start[y[0]] + sum(t[a, b] + s[i + 1][b] for i, (a, b) in enumerate(zip(y, y[1:], strict=False)))
    assert total(model.viterbi(f)) == pytest.approx(max(total(y) for y in product(range(3), repeat=len(f))))
    p, _ = model.marginals(f)
    assert np.allclose(p.sum(axis=1), 1)


def test_scan_on_spark(spark, model):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    for r in scan.scan(df, model).collect():
        base = plain_base(TEXTS[r.doc_id])
        joined = ",".join(f"{scan.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) - {""} <= set(r.spans.split(","))
    assert scan.scan(df.limit(0), model).count() == 0


def test_redaction():
    assert scan.redact("a token=12345678 b", [(2, 0, 16), (8, 2, 16)]) == "a [SECRET] b"


def test_scan_stage_keeps_rows(spark):
    df = spark.createDataFrame([(1, "x token=12345678", 16), (2, "clean words", 11), (3, None, None)], "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, scan.stage(spark, df, "").collect()))
    assert got == [(1, "x [SECRET]", 10), (2, "clean words", 11), (3, None, None)]


def test_op6(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op6_secret_scan"](spark, sf).collect():
        joined = ",".join(f"{scan.KINDS[k]}:{s}:{e}" for s, k, e in plain_base(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


# mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, list(order), float(sum(sizes.values()))
    while open_:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > most * sizes[s]]
        if not over:
            total = sum(weight[s] for s in open_)
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def test_targets_are_capped_and_reshared(spark):
    rng = random.Random(8)
    cases = [{"b": 100, "a": 100, "c": 10, None: 10}, {}, {"a": 0}, {"a": 5}, {"a": 0, "b": 9}, {f"s{rng.random()}é": int(10 ** rng.uniform(0, 5)) for _ in range(200)} | {None: 7, "\U0001f600": 3, "\uffff": 4}]
    for sizes in cases:
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, rows long")
        assert {r.source: r.target for r in mixing.targets(df).collect()} == pytest.approx(plain_targets(sizes))


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(2)
    size, pi = rng.integers(1, 900, 500).astype(float), rng.random(500)
    p = mixing.fly(pi, size, rng)
    assert ((p > 1e-9) & (p < 1 - 1e-9)).sum() <= 2
    assert p.sum() == pytest.approx(pi.sum()) and p @ size == pytest.approx(pi @ size)
    done = mixing.land(p, size)
    assert set(np.unique(done)) <= {0.0, 1.0} and abs(done @ size - pi @ size) < 30
    assert len(mixing.fly(np.empty(0), np.empty(0), rng)) == 0


def test_draw(spark):
    rng = random.Random(1)
    rows = [(i, i if i % 50 else None, ["a", "b", "c", None][min(3, int(rng.random() ** 2 * 5))], rng.randint(0, 400)) for i in range(4000)]
    rows += [(9999, None, "a", 5)] * 300  # one row many times
    df = spark.createDataFrame(rows, f"{common.KEYS[0]} long, doc_id long, source string, size long").withColumn(common.KEYS[1], F.lit(0).cast("long"))
    got = mixing.draw(df, block=64).collect()
    assert sorted(r[0] for r in got) == [*range(4000), *[9999] * 300]
    draws = [sorted(map(str, mixing.draw(x, block=64).collect())) for x in (df, df.repartition(5))]
    assert draws[0] == draws[1]
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= max(400, 0.02 * own[0].target)
        assert all(0 <= r.copies <= 3 for r in own)
    assert mixing.draw(df.limit(0)).count() == 0


def test_stage_of_odd_rows(spark):
    rows = [(i, "w " * (i % 9), "ab"[i % 2], i) for i in range(60)] + [(None, None, None, 1), (7, "", None, 2)] + [(70, "x y", "a", 3)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").withColumns({"row": F.lit(1), "size": F.create_map(F.lit("k"), F.lit(2)), "target": F.lit("t")})
    out = mixing.stage(spark, df, "")
    assert out.columns == df.columns
    got = Counter(r.doc_id for r in out.collect())
    assert max(n for i, n in got.items() if i != 70) <= 3 and got[70] <= 60
    want = plain_targets({"a": sum(len((t or "").split()) for _, t, s, _ in rows if s == "a"), "b": sum(len((t or "").split()) for _, t, s, _ in rows if s == "b"), None: 0})
    for s in "ab":
        assert abs(sum(len(r.text.split()) for r in out.where(F.col("source") == s).collect()) - want[s]) <= 8
    assert sorted(map(str, mixing.stage(spark, df.repartition(3), "").collect())) == sorted(map(str, out.collect()))
    assert mixing.stage(spark, df.limit(0), "").count() == 0


def test_op9_and_reruns(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sorted(map(tuple, queries.QUERIES["op9_mix_sources"](spark, sf).collect()))
    assert got == sorted(map(tuple, queries.QUERIES["op9_mix_sources"](spark, sf).collect()))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in docs.items()}
    assert {g[0]: g[1] for g in got} == size and all(g[4] <= 3 * g[1] for g in got)
    assert sum({docs[g[0]].source: g[3] for g in got}.values()) == pytest.approx(sum(size.values()))
    for s in {r.source for r in docs.values()}:
        own = [g for g in got if docs[g[0]].source == s]
        assert abs(sum(g[4] for g in own) - own[0][3]) <= max(max(g[1] for g in own), 0.01 * own[0][3])


# packing


def valid(p, sizes, capacity):
    assert sorted(i for b in p.bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) == f <= capacity for b, f in zip(p.bins, p.fills, strict=True))


def test_operators_keep_packings_valid():
    rng = random.Random(5)
    sizes = [rng.randint(20, 60) for _ in range(120)]
    a = packing.best_fit(list(range(120)), sizes, 100, [], [])
    b = packing.mutate(a, sizes, 100, rng)
    for p in (a, b, packing.crossover(a, b, sizes, 100, rng), packing.crossover(b, a, sizes, 100, rng)):
        valid(p, sizes, 100)
    best = packing.evolve([a], sizes, 100, rng)[0]
    valid(best, sizes, 100)
    assert len(best.bins) <= len(a.bins)


def test_pack_over_shards_and_islands(spark):
    rng = random.Random(6)
    sizes = [rng.randint(1, 70) for _ in range(900)] + [100] * 5
    df = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    got = packing.pack(df, capacity=100, shard=120).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(r.item for r in got) == list(range(905))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 100
    assert len(bins) <= 1.03 * (-(-sum(sizes) // 100)) + 1
    assert packing.pack(df.limit(0)).count() == 0


def test_op4(spark, sf):
    tok = Tokenizer.from_file(packing.vocabulary())
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op4_best_fit_packing"](spark, sf).collect()
    want = {(i, k): (s, len(x[s : s + 4096]), zlib.crc32(np.array(x[s : s + 4096], "<u4").tobytes())) for i, x in ids.items() for k, s in enumerate(range(0, len(x), 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    assert len({r.sequence_id for r in got}) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_packing_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "word " * 9000)], "doc_id long, text string").selectExpr("*", "0 AS length", "0 AS item")
    got = packing.pack_documents(df).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got) == [(0, 0, 1), (1, 0, 1), (1, 0, 1), (2, 0, 4096), (2, 1, 4096), (2, 2, 809)]


# tokens

def ids_of(encoder, texts):
    flat, sizes = encoder.encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


ODD = ["a\x1c!b", "!\x1c! x", "İΣΣ ΑΣ σΣ", " \n\n  x\n y  ", "don't 'S 'LL", "é ́x É", "<|endoftext|> a", " a　　b", "", " ", "x² ½a ⅷ", "日本語, ok", "word. word, Word.", "ǅ ŉ ß. ﬁ,", "q" * 500]


@pytest.mark.parametrize("path, space", [(token_store.vocabulary(), True), (packing.vocabulary(), False)])
def test_cached_ids_are_the_librarys(path, space):
    fresh, own = Tokenizer.from_file(path), wordcache.ChunkTokenizer(path, space, max_entries=40)
    texts = ODD + [f"{a} {b}" for a in ODD for b in ODD] + [f"{a}{w}{b}" for a in ("a", "b.", "'s") for w in ("\n", " ", "\n\n", " \n", "\t", "\u3000", "\r\n") for b in ("c", "'ll", "1,", "")]
    for _ in range(2):
        for text, ids in zip(texts, ids_of(own, texts), strict=True):
            assert ids == fresh.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path, space", [(token_store.vocabulary(), True), (packing.vocabulary(), False)])
def test_added_tokens_are_those_of_a_fresh_tokenizer(path, space):
    fresh, own = Tokenizer.from_file(path), wordcache.ChunkTokenizer(path, space, max_entries=40)
    marks = ["a <|endoftext|> b", "<|startoftext|>A  b<|endoftext|><|endoftext|>", "x<|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>", "<|endoftext|></w>\n"]
    texts = ODD + marks + [f"{a} {b}" for a in ODD for b in marks] + [b + a for a in ODD for b in marks]
    for text, ids in zip(texts, ids_of(own, texts), strict=True):
        assert ids == fresh.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_op4_and_op7(spark):
    from annalist.llm import common

    rows = [(1, "a <|endoftext|> b"), (2, "<|startoftext|> c<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS length", "0 AS item", "0 AS start")
    crc = lambda path, text, end: zlib.crc32(np.array([*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, end], "<u4").tobytes())
    assert {r.doc_id: r.ids_crc32 for r in packing.pack_documents(df).collect()} == {i: crc(packing.vocabulary(), t, 1) for i, t in rows}
    folder = common.scratch(spark, "t")
    got = token_store.decode(token_store.encode(df, folder, token_store.vocabulary()), folder).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == {i: crc(token_store.vocabulary(), t, 2) for i, t in rows}


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 200_000])
def test_files_come_back(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.002, n), 50_000).astype("<u2")
    lengths = token_store.code_lengths(np.bincount(ids, minlength=50_257))
    docs = np.array_split(ids, max(1, n // 300))
    names = [None if i == 0 else i for i in range(len(docs))]
    sink = io.BytesIO()
    assert token_store.write_file(sink, [(pa.array(names, pa.int64()), pa.array([d.tobytes() for d in docs], pa.binary()))], lengths, 7) == (len(docs), n)
    out = list(token_store.read_file(sink.getvalue(), slice_blocks=3))
    assert (np.concatenate([o[2] for o in out] or [ids[:0]]) == ids).all()
    if n:
        assert [x for o in out for x in o[0].to_pylist()] == names and out[0][3] == 7


def test_code_lengths_are_limited_and_optimal():
    import heapq

    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    lengths = token_store.code_lengths(counts)
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    assert int((lengths * counts).sum()) == cost
    short = token_store.code_lengths(counts, longest=4)
    assert short.max() == 4 and sum(2.0 ** -int(x) for x in short if x) <= 1
    assert token_store.code_lengths(np.array([0, 9])).tolist() == [0, 1]


def test_op7(spark, sf):
    tok = Tokenizer.from_file(token_store.vocabulary())
    docs, start, want = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), 0, []
    for i, t in docs:
        x = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, queries.QUERIES["op7_token_store"](spark, sf).collect())) == want


def test_token_store_of_odd_rows(spark):
    from annalist.llm import common

    df = spark.createDataFrame([(2, None), (None, "b"), (1, "a a"), (1, "a a")], "doc_id long, text string").selectExpr("*", "0 AS start")
    folder = common.scratch(spark, "t")
    got = token_store.decode(token_store.encode(df, folder, token_store.vocabulary()), folder).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (1, 2, 3), (1, 5, 3), (2, 8, 1)]
    folder = common.scratch(spark, "t")
    assert token_store.decode(token_store.encode(df.limit(0), folder, token_store.vocabulary()), folder).count() == 0
