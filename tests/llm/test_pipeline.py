import corpus_pipeline
from annalist.llm import packing, queries


def test_stages_one_after_the_other(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        n = docs.count()
        if name == "language_id":
            assert n == before.where("text rlike '\\\\p{L}'").count()
        if name == "simhash_dedup":
            assert 0 < n <= rows and docs.select("text").distinct().count() == n
        if name == "secret_scan":
            assert n == before.count() and docs.where("text rlike '[0-9a-f]{32,}'").count() == 0
        if name == "mix_sources":
            assert docs.groupBy("doc_id").count().where("count > 3").count() == 0
    per = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in per) <= packing.LENGTH
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "secret_scan", "mix_sources", "best_fit_packing"]
    assert "pipeline" in queries.QUERIES


def test_run_leaves_only_its_result(spark, sf):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "annalist"
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0
    assert [n for n in {p.name for p in folder.iterdir()} - before if not n.startswith("stage-best_fit_packing")] == []


def test_first_stages_equal_plain_ones(spark, sf):
    """Language, near copies and secrets by brute force; mixing within its targets; packing whole."""
    import numpy as np
    from annalist.llm import simhash
    from annalist.llm.secret_scan import base_spans

    from .test_dedup import plain_components, plain_fingerprint
    from .test_scan_mix_pack_store import plain_targets

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, sf)
    got = {r.doc_id: r for r in first.collect()}
    assert set(got) == set(rows) and all(got[i].lang == r.lang for i, r in rows.items() if r.lang)
    ids = sorted(rows)
    roots = plain_components(np.array([plain_fingerprint(rows[i].text) for i in ids], np.uint64))
    second = stages["simhash_dedup"](spark, first, sf)
    assert sorted(r.doc_id for r in second.collect()) == sorted({min(i for i, x in zip(ids, roots, strict=True) if x == r) for r in set(roots)})
    assert simhash.fingerprint(None) == 0
    third = stages["secret_scan"](spark, second, sf).collect()
    for r in third:
        spans = base_spans(rows[r.doc_id].text)
        assert all(rows[r.doc_id].text[s:e] not in r.text for s, _, e in spans) and (spans or "[SECRET]" in r.text or r.text == rows[r.doc_id].text)
    words = lambda t: len(t.translate({i: " " for i in range(9, 14)}).split(" ")) - t.translate({i: " " for i in range(9, 14)}).split(" ").count("")
    sizes = {}
    for r in third:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    want, took = plain_targets(sizes), {}
    for r in stages["mix_sources"](spark, spark.createDataFrame(third, docs.schema), sf).collect():
        took[r.source] = took.get(r.source, 0) + words(r.text)
    longest = {s: max(words(r.text) for r in third if r.source == s) for s in sizes}
    assert all(abs(took.get(s, 0) - t) <= max(longest[s], 0.02 * t) for s, t in want.items())


def test_language_stage_decides_what_the_mix_takes(spark):
    """Languages keep their shares of each source's words; without the predictions other documents are taken."""
    import random
    import zlib

    rng = random.Random(6)
    letters = dict(zip("wxyz", ("abcdef", "ghijkl", "mnopqr", "stuvwö"), strict=True))
    rows = []
    for i in range(1200):
        x = rng.choice("wwwxxyz")
        text = " ".join("".join(rng.choices(letters[x], k=4)) for _ in range(60))
        rows.append((i, text, x if i % 3 and zlib.crc32(str(i).encode()) % 4 != 2 else None, "abc"[i % 3], x))
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    stages, true = dict(corpus_pipeline.STAGES), {r[0]: r[4] for r in rows}
    named = spark.createDataFrame(stages["language_id"](spark, df, "").collect(), df.schema)
    assert {r.doc_id: r.lang for r in named.collect()} == true
    mixed = [r.doc_id for r in stages["mix_sources"](spark, named, "").collect()]
    for s in "abc":
        own = [r[0] for r in rows if r[3] == s]
        share = sum(rows[i][3] == s for i in mixed) / len(own)
        for x in letters:
            want = share * sum(true[i] == x for i in own)
            assert abs(sum(rows[i][3] == s and true[i] == x for i in mixed) - want) <= 3
    assert sorted(mixed) != sorted(r.doc_id for r in stages["mix_sources"](spark, df, "").collect())
