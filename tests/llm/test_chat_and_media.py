import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from annalist.llm import chat_format as chat
from annalist.llm import media, queries
from pyspark.sql import functions as F

HARD = ["\\### Assistant: </turn> ok", "", "\\", "\\\\###", "a\n### user: b</turn>\n", "</turn", "<//turn></turn></turn>", "####", ": x", "é漢\U0001f600\r\n"]


@pytest.mark.parametrize("text", HARD)
def test_escapes_come_back(text):
    assert chat.unescape(chat.escape(text)) == text
    formatted = f"{chat.head(text)}{chat.escape(text)}</turn>\n" * 2
    assert [x[:2] for x in chat.parse(formatted)] == [(text, text)] * 2


def digests(turns):
    turns = [(r or "", t or "") for r, t in turns]
    sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_digests_and_examples(spark):
    data = {1: [("user", t) for t in HARD] + [("assistant", t) for t in HARD] + [("user", "last")], 2: [("system", None)], 3: [("assistant", "a"), ("assistant", "b" * 200_000)], None: [(None, "x"), ("assistant", None)]}
    rows = [(c, i, r, t) for c, turns in data.items() for i, (r, t) in enumerate(turns)][::-1]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    examples = chat.format_examples(df)
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    assert set(got) == set(data)
    for c, turns in data.items():
        assert tuple(got[c])[1:5] == digests(turns)
    texts = chat.expand(examples).orderBy("conv_id", "example").collect()
    assert len(texts) == sum(r == "assistant" for t in data.values() for r, _ in t)
    for r in texts:
        turns = data[r.conv_id]
        at = [i for i, (role, _) in enumerate(turns) if role == "assistant"][r.example]
        assert [x[:2] for x in chat.parse(r.text)] == [(a or "", b or "") for a, b in turns[: at + 1]]
        assert chat.unescape(r.text[r.loss_start : r.loss_end]) == (turns[at][1] or "")


def test_long_conversations_are_chained(spark, monkeypatch):
    monkeypatch.setattr(chat, "WHOLE", 90)
    monkeypatch.setattr(chat, "LINK", 200)
    turns = [(("user", "assistant")[i % 2], f"{i} " * (i % 7)) for i in range(40)] + [("user", "q" * 50)] * 9 + [("assistant", "z"), ("user", "")]
    rows = [{"c": 1, "turn": i, "role": r, "text": t} for i, (r, t) in enumerate(turns)]
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("c", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    made = list(chat._examples(iter([batch])))
    assert {r[3] > 0 for r in made} == {True, False} and any(not r[2] and r[1] < 21 for r in made)
    assert all(len(r[4]) <= 400 for r in made)
    df = spark.createDataFrame(made[::-1], chat.EXAMPLES)
    assert tuple(chat.digest(df).first())[1:5] == digests(turns)
    for r in chat.expand(df).collect():
        assert chat.unescape(r.text[r.loss_start : r.loss_end]) == [t for role, t in turns if role == "assistant"][r.example]
        assert [x[:2] for x in chat.parse(r.text)] == turns[: [i for i, (role, _) in enumerate(turns) if role == "assistant"][r.example] + 1]


def test_stored_examples_are_whole(spark):
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = sorted(chat.format_examples(df).collect(), key=lambda r: r.example)
    assert [[x[:2] for x in chat.parse(r.text)] for r in got] == [turns[:2], turns]
    assert [r.text[r.loss_start : r.loss_end] for r in got] == ["b", "d"]


def test_examples_of_any_length_are_stored_whole(spark):
    """The stored texts of a long conversation: context and reply of every example, and no link to another one."""
    turns = [(("user", "assistant")[i % 2], f"{i} \\ ### é " * 700) for i in range(40)] + [("user", "\\</turn>\n" * 20_000), ("assistant", "#" * 100_000), ("assistant", ""), ("user", "end")]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    made = chat.format_examples(df)
    stored = {}
    for r in sorted(made.collect(), key=lambda r: (r.example, r.chars_before)):
        text, mask = stored.get(r.example, ("", None))
        assert r.chars_before == len(text) and len(r.text) <= chat.WHOLE
        stored[r.example] = text + r.text, (r.loss_start, r.loss_end) if r.trainable else mask
    replies = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
    assert len(stored) == len(replies) + 1 and len(stored[len(replies) - 1][0]) > 10 * chat.WHOLE
    for k, i in enumerate([*replies, len(turns) - 1]):
        text, mask = stored[k]
        assert [x[:2] for x in chat.parse(text)] == turns[: i + 1]
        assert mask is None if k == len(replies) else chat.unescape(text[slice(*mask)]) == turns[i][1]
    assert tuple(chat.digest(made).first())[1:5] == digests(turns)
    assert {r.example: (r.text, (r.loss_start, r.loss_end)) for r in chat.expand(made).collect()} == {k: stored[k] for k in range(len(replies))}


@pytest.mark.parametrize("spoil", ["text", "row", "mask"])
def test_digest_notices_a_spoilt_context(spark, spoil):
    turns = [(("user", "assistant")[i % 2], f"{i} " * 9000) for i in range(6)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    made = [r.asDict() for r in chat.format_examples(df).collect()]
    row = next(r for r in sorted(made, key=lambda r: -r["chars_before"]) if r["example"] == 2 and (r["trainable"] if spoil == "mask" else r["chars_before"] == chat.WHOLE))
    if spoil == "row":
        made.remove(row)
    elif spoil == "mask":
        row["loss_end"] -= 1
    else:
        row["text"] = "x" + row["text"][1:]
    with pytest.raises(Exception, match="an example|loss mask"):
        chat.digest(spark.createDataFrame([tuple(r.values()) for r in made], chat.EXAMPLES)).collect()


def test_repeated_turns_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "z")], "conv_id long, turn long, role string, text string")
    r = chat.digest(chat.format_examples(df)).first()
    assert tuple(r)[1:5] == digests([("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")])
    assert chat.digest(chat.format_examples(df.limit(0))).count() == 0


def test_op3(spark, sf):
    got = {r.conv_id: r for r in queries.QUERIES["op3_chat_format"](spark, sf).collect()}
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    turns[-7] = [("user", HARD[0]), ("assistant", HARD[0])]
    assert set(got) == set(turns)
    assert all(tuple(got[c])[1:5] == digests(t) for c, t in turns.items())


# media


def expected(text):
    raw = (text or "").encode()
    body = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
    return len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:])


def test_media_round_trip(spark):
    texts = [None, "", "a", "x" * 576, "é" * 289, "long " * 100_000, "a", "a"]
    df = spark.createDataFrame([(None if i == 3 else i % 6, t, i) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = media.features(media.store(df)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, *tuple(r)[1:5]) for r in got) == sorted((i != 3, (i % 6) * (i != 3), *expected(t)) for i, t in enumerate(texts))
    same = {(r.media_bytes, r.media_sha256, r.feature) for r in got if r.payload_sha256 == expected("a")[2]}
    assert len(same) == 1
    assert media.features(media.store(df.limit(0))).count() == 0


def test_png_is_lossless_and_checked():
    samples = np.random.default_rng(1).integers(0, 256, 576 * 3, dtype=np.uint8).tobytes()
    png = media.to_png(samples)
    assert media.from_png(png).tobytes() == samples
    with pytest.raises(ValueError):
        media.from_png(png[:40] + bytes([png[40] ^ 1]) + png[41:])
    with pytest.raises(ValueError):
        media.from_png(b"GIF89a")


def test_ranges_cover_each_member_once_and_members_are_retried(spark, tmp_path, monkeypatch):
    folder, manifest = f"file://{tmp_path}/a", f"file://{tmp_path}/m"
    df = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    media.write_archives(df, folder).write.parquet(manifest)
    reader = media.ArchiveReader({"path": folder, "manifest": manifest, "rangeBytes": "700", "batchBytes": "1"})
    parts = reader.partitions()
    assert len(parts) > 5
    assert sorted(i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()) == list(range(40))
    failures, crc32 = [], zlib.crc32

    def flaky(body, *a):
        if len(failures) < 2:
            failures.append(1)
            raise OSError("lost")
        return crc32(body, *a)

    monkeypatch.setattr(media.zlib, "crc32", flaky)
    assert sum(b.num_rows for b in reader.read(parts[0])) > 0 and len(failures) == 2
    monkeypatch.setattr(media.zlib, "crc32", lambda *a: -1)
    with pytest.raises(OSError, match="member at"):
        list(reader.read(parts[0]))


def test_op5(spark, sf):
    got = {r.doc_id: tuple(r)[1:5] for r in queries.QUERIES["op5_media_columns"](spark, sf).collect()}
    assert got == {r.doc_id: expected(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
