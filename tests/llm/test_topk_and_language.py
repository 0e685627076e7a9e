import math
import random
import zlib

import numpy as np
import pytest
from annalist.llm import language_id as lang
from annalist.llm import queries, topk_search

from ..oracle import compare


def test_op1_equals_its_sql(spark, sf):
    compare(spark, sf, queries.QUERIES["op1_topk_search"], queries.ORACLE_SQL["op1_topk_search"])


def brute(vectors, k=5):
    out = []
    for q, v in vectors.items():
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in vectors.items() if c != q and len(w) == len(v))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def test_search_with_ties_repeats_and_bad_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.choice([-0.5, 0.0, 0.25, 0.3]))) for _ in range(40)]) for i in range(120)]
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    bad = [(500, None), (550, [None] * 40), (600, [float("nan")] * 40), (650, [float("inf")] * 40), (700, []), (None, [0.1] * 40), (750, [0.1, 0.2])]
    good[750] = [25, 51]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank")
    vectors = topk_search.quantize(df)
    got = topk_search.search(vectors.where("vec_id % 50 = 0"), vectors, group=2, block=16)
    assert sorted(tuple(r) for r in got.collect()) == brute(good)


def test_bounds_keep_all_that_tie():
    block = np.array([[1, 1], [1, 1], [0, 2], [-5, -5]] * 4)
    s = topk_search.BlockSearch(np.array([99]), np.array([[1, 1]]), 3, step=1)
    s.add(np.arange(16)[::-1].copy(), block)
    s.add(np.array([20]), np.array([[2, 0]]))
    assert list(s.rows()) == [(99, 1, 2), (99, 2, 2), (99, 3, 2)]


def test_large_components_stay_exact():
    s = topk_search.BlockSearch(np.array([1]), np.array([[2**40, 1]]), 2)
    s.add(np.array([2, 3]), np.array([[2**20, 1], [2**20, 2]]))
    assert list(s.rows()) == [(1, 3, 2**60 + 2), (1, 2, 2**60 + 1)]


def test_near_scores_beyond_doubles():
    q = np.zeros((1, 24), np.int64)
    q[0, [0, 1, 20]] = 2**29, 1, 5
    c = np.zeros((2, 24), np.int64)
    c[0, [0, 1]], c[1, [0, 20]] = (2**29, 39), (2**29, 8)
    for order in ([0, 1], [1, 0]):
        s = topk_search.BlockSearch(np.array([1]), q, 1)
        for i in order:
            s.add(np.array([10 + i]), c[[i]])
        assert list(s.rows()) == [(1, 11, 2**58 + 40)]


def test_scores_beyond_a_long_count_as_the_nearest():
    big = np.array([[2**62, 2**62]])
    for sign, want in ((1, 2**63 - 1), (-1, -(2**63))):
        s = topk_search.BlockSearch(np.array([1]), big * sign, 2)
        for i in (4, 3, 2):
            s.add(np.array([i]), big - i)
        assert list(s.rows()) == [(1, 2, want), (1, 3, want)]


def test_repeated_rows_and_huge_components(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.0, 0.25]), (3, [1e300, 0.0])]
    v = topk_search.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk_search.search(v.where("vec_id = 50"), v, k=3).collect()
    assert sorted(map(tuple, got)) == [(50, 1, 1, 65536), (50, 2, 1, 65536), (50, 3, 1, 32768)]


def test_empty_search(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    v = topk_search.quantize(df)
    assert topk_search.search(v, v).count() == 0


# language


def words(letters, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def phrases(text, train):
    """Greedy longest matches, by search."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at : at + k] in train:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def test_phrases_are_longest_matches():
    model = lang.fit([(words("abcde", 300, 1), "x"), (words("cdefg", 300, 2), "y")])
    parser = lang.Parser(model, window=64)
    texts = [lang.symbols(words("abcdefg", n, n)) for n in (1, 5, 40)]
    got = parser.phrases([parser.encode(t) for t in texts])
    trained = [lang.symbols(words("abcde", 300, 1)), lang.symbols(words("cdefg", 300, 2))]
    for t, row in zip(texts, got, strict=True):
        assert list(row) == [phrases(t, s) for s in trained]


def test_large_alphabets_keep_their_letters():
    han, kana, more = ([chr(c) for c in range(a, b)] for a, b in ((0x4E00, 0x4F00), (0x4F00, 0x5000), (0xAC00, 0xAC80)))
    made = [words(x, 1200, k) for k, x in enumerate(("abcdefg", han, kana, han[:200] + more))]
    model = lang.fit([(t, n) for t, n in zip(made, "ahkz", strict=True)])
    assert set(model.letters) == {c for t in made for c in t} - {" "}
    parser = lang.Parser(model, window=64)
    texts = [lang.symbols(words(x, 30, 50 + k)) for k, x in enumerate(("abcdefg", han, kana, more))]
    for t, row in zip(texts, parser.phrases([parser.encode(t) for t in texts]), strict=True):
        assert list(row) == [phrases(t, s) for s in made]
    assert [g[0] for g in parser.predict(texts)] == list("ahkz")


@pytest.mark.parametrize("window", [1, 2, 5, 16])
def test_walks_that_never_meet(window):
    rng = random.Random(window)
    made = ["ab" * 3 + "c" + "aab" * 2, "".join(rng.choice("ab") for _ in range(40))]
    parser = lang.Parser(lang.fit([(t, n) for t, n in zip(made, "xy", strict=True)]), window=window)
    texts = ["ab" * 90, "a" * 101, "aab" * 50, "", "q", "abcq" * 30, *("".join(rng.choice("abcq") for _ in range(rng.randint(1, 200))) for _ in range(40))]
    for t, row in zip(texts, parser.phrases([parser.encode(t) for t in texts]), strict=True):
        assert list(row) == [phrases(t, s) if t else 0 for s in made]


def test_samples_and_models_are_bounded(spark):
    one = spark.range(3000).selectExpr("7 AS doc_id", "concat('text ', id % 900, repeat(' abc', 60)) AS text", "'x' AS lang")
    many = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', 50) AS text", "concat('l', id % 300) AS lang")
    assert len(lang.labelled_sample(one, rows_per_language=60)) <= 60
    sample = lang.labelled_sample(many, rows_per_language=5, languages=100, characters_per_row=50)
    assert len({x for _, x in sample}) == 100 and len(sample) <= 500 and max(len(t) for t, _ in sample) == 50
    model = lang.fit([(words("abcdefgh", 3000, k), str(k)) for k in range(100)], symbols_in_all=100_000)
    assert sum(model.lengths) <= 100_000 and sum(x.nbytes for t in model.tables for x in (t.masks, t.first, t.to)) < 9_000_000


def test_suffix_automaton_holds_all_substrings():
    seq = [1, 2, 1, 1, 2, 3, 1, 2]
    a = lang.SuffixAutomaton(seq)
    walk = lambda s: all((st := (a.next[st].get(c, -1) if st >= 0 else -1)) >= 0 for c in s) if (st := 0) == 0 else None
    subs = {tuple(seq[i:j]) for i in range(len(seq)) for j in range(i + 1, len(seq) + 1)}
    for x in [(1, 2), (1, 1, 2), (3, 1), (2, 2), (3, 3), (1, 2, 3, 1, 2), (2, 1, 2)]:
        assert bool(walk(x)) == (x in subs)


def test_edge_texts():
    model = lang.fit([("abc abd abe " * 30, "x"), ("xyz xyw xyv " * 30, "y")])
    got = lang.Parser(model).predict([None, "", "12 !!", "ABC abd", "xyz " * 50_000, "語"])
    assert [g[0] for g in got[:3]] == ["und"] * 3 and got[3][0] == "x" and got[4][0] == "y" and got[5][0] in "xy"
    assert all(0 <= s <= 1 for _, s in got)
    assert lang.Parser(lang.fit([])).predict(["abc"]) == [("und", 0.0)]


def test_op2_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op2_language_id"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]
    assert sum(held) >= 0.97 * len(held)


def test_learning_leaves_the_fold_out(spark):
    df = spark.createDataFrame([(i, "abc def " * 40, "x") for i in range(40)] + [(None, "q", "x"), (100, None, "y"), (101, "zz", None)], "doc_id long, text string, lang string")
    sample = lang.labelled_sample(df)
    assert len(sample) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))
    assert lang.labelled_sample(df.limit(0)) == []


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "a", "x")] * 3])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS held_out")
    got = lang.identify(df, lang.fit(lang.labelled_sample(df)))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(rows)


def test_stage_keeps_what_has_a_language(spark):
    df = spark.createDataFrame([(1, "abc " * 60, "x", "s"), (2, None, "x", "s"), (3, "123", None, None), (4, "abc", None, "s")], "doc_id long, text string, lang string, source string")
    out = lang.stage(spark, df, "")
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 4]


def test_stage_keeps_letters_without_a_model(spark):
    rows = [(1, "abc", None), (2, "123", None), (3, None, None), (4, "語 12", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(map(tuple, lang.stage(spark, df, "").collect())) == [rows[0], rows[3]]
    fold = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    held = spark.createDataFrame([(fold, "abc def", "x")], df.schema)
    assert list(map(tuple, lang.stage(spark, held, "").collect())) == [(fold, "abc def", "x")]


def test_stage_fills_missing_languages(spark):
    free = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(free[0], "abc abd abe " * 30, "x"), (free[1], "xyz xyw xyv " * 30, "y"), (free[2], "abd abc", None), (free[3], "xyw xyz", None), (free[4], "abc", "y"), (None, "abe abd", None), (free[5], "12", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.text): r.lang for r in lang.stage(spark, df, "").collect()}
    assert got == {(i, t): {None: "y" if t[0] == "x" else "x"}.get(x, x) for i, t, x in rows if t != "12"}


def test_stage_overrules_labels_that_the_text_contradicts(spark):
    import random

    rng = random.Random(4)
    words = {x: ["".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(300)] for x, letters in (("x", "abcdefgh"), ("y", "nopqrstu"))}
    text = lambda x, n: " ".join(rng.choices(words[x], k=n))
    rows = [(i, text(x := "xy"[i % 2], 200), x) for i in range(80)]
    wrong = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 4 == 2)  # not learned from
    odd = [(wrong, text("x", 150), "y"), (wrong, text("x", 8), "y"), (wrong, text("y", 150) + " " + text("x", 20), "y"), (wrong, text("x", 150), "z"), (None, text("y", 150), None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.text: r.lang for r in lang.stage(spark, df, "").collect()}
    assert all(got[t] == x for _, t, x in rows)
    assert [got[t] for _, t, _ in odd] == ["x", "y", "y", "z", "y"]
