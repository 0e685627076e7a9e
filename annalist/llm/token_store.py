"""Operator 7: token ids in binary files, by canonical length-limited Huffman coding.

Documents are dealt to ranges of doc_id and tokenized in order; ids wait in compressed Arrow files.
Global counts (a sum by id, at most the vocabulary's size) give code lengths of at most 16 bits by
package-merge, and canonical codes.  Each range becomes one file: code lengths, the documents' ids and
token counts, a bit offset as checkpoint for every block of ``BLOCK`` tokens, and the bit stream.
Blocks decode independently: the decoder steps through many blocks at once, one table look-up (the
next 16 bits) a token.

Scale: one range partition is in a task at a time, and coded in slices; the driver sees a row for each
file, and the counts by id.  Files carry names of the attempt's own and count only when their row
came back, so a lost task is repeated without harm.

Defined results: null text is empty (one token, the end id).  Null doc_ids come first.  Documents that
share a doc_id stand in the order of their texts.  An empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordcache import pieces_of, release, tokenizer

END = 2
LONGEST = 16
BLOCK = 1024
MAGIC = b"ANLHUF1\n"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# code construction


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits for the symbols with a count (package-merge); 0 for others."""
    used = np.nonzero(counts)[0]
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError("more symbols than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, kinds = leaves, [np.ones(len(leaves), bool)]
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        sort = np.argsort(both, kind="stable")
        level = both[sort]
        kinds.append(sort < len(leaves))
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for kind in reversed(kinds):
        n = int(kind[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.nonzero(lengths)[0]
    for s in used[np.lexsort((used, lengths[used]))]:
        n = int(lengths[s])
        code <<= n - last
        codes[s], last = code, n
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every 16 bits that may come next: the symbol, and its length."""
    codes = canonical(lengths)
    symbol, size = np.zeros(1 << LONGEST, np.uint16), np.ones(1 << LONGEST, np.uint8)
    used = np.nonzero(lengths)[0]
    used = used[np.lexsort((used, lengths[used]))]
    spans = np.left_shift(1, LONGEST - lengths[used].astype(np.int64))
    filled = int(spans.sum())
    symbol[:filled] = np.repeat(used, spans)
    size[:filled] = np.repeat(lengths[used], spans)
    assert not len(used) or int(codes[used[0]]) == 0
    return symbol, size


class BitWriter:
    """Appends codes to a bit stream, in slices."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.int64), canonical(lengths)
        self.parts: list[bytes] = []
        self.bits, self.word = 0, np.uint64(0)

    def add(self, ids: np.ndarray) -> np.ndarray:
        """The bit offsets at which the ids start."""
        if not len(ids):
            return np.empty(0, np.int64)
        n, code = self.lengths[ids], self.codes[ids]
        phase = self.bits & 63
        ends = np.cumsum(n) + phase
        starts = ends - n
        word, shift = starts >> 6, 64 - (starts & 63) - n
        spill = np.nonzero(shift < 0)[0]
        high = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
        first = np.concatenate([[0], np.nonzero(np.diff(word))[0] + 1])
        out = np.zeros(int(ends[-1] >> 6) + 1, np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(high, first)
        if len(spill):
            out[word[spill] + 1] |= code[spill] << (64 + shift[spill]).astype(np.uint64)
        out[0] |= self.word
        at = starts + (self.bits - phase)
        self.bits += int(ends[-1]) - phase
        self.parts.append(out[:-1].astype(">u8").tobytes())
        self.word = out[-1]
        return at

    def finish(self) -> bytes:
        return b"".join([*self.parts, int(self.word).to_bytes(8, "big")])


def decode_blocks(stream: np.ndarray, checkpoints: np.ndarray, counts: np.ndarray, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The tokens of consecutive blocks, all blocks in step.  stream: bytes, with 4 or more to spare."""
    if not len(checkpoints):
        return np.empty(0, np.uint16)
    base = int(checkpoints[0]) >> 3
    d = stream[base:].astype(np.uint32)
    window = (d[:-2] << 16) | (d[1:-1] << 8) | d[2:]
    at = checkpoints.astype(np.int64) - 8 * base
    out = np.zeros((int(counts.max()), len(at)), np.uint16)
    for k in range(out.shape[0]):
        live = slice(None) if k < counts[-1] else slice(0, len(at) - 1)  # only the last block may be shorter
        p = at[live]
        peek = (window[p >> 3] >> (8 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[k, live] = symbol[peek]
        at[live] = p + size[peek]
    return np.concatenate([out[:, :-1].T.ravel(), out[: int(counts[-1]), -1]])


# files

_WAITING = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
MANIFEST = "part int, path string, docs long, tokens long, counts binary"


def _tokenize(folder: str, path: str, end: int, vocab: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path, keeps_space=True)
        counts, docs, tokens, sink, writer = np.zeros(vocab, np.int64), 0, 0, None, None
        files, top = common.filesystem(folder)
        name = f"{top}/{uuid.uuid4().hex}.arrow"
        for batch in batches:
            for at, texts in pieces_of(batch.column(1)):
                flat, sizes = encoder.encode(texts)
                flat = np.insert(flat, np.cumsum(sizes), end)
                if writer is None:
                    files.create_dir(top, recursive=True)
                    sink = files.open_output_stream(name)
                    writer = pa.ipc.new_file(sink, _WAITING, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                edges = np.concatenate([[0], np.cumsum(sizes + 1)]) * 2
                packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(flat)])
                writer.write_batch(pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), packed], schema=_WAITING))
                counts += np.bincount(flat, minlength=vocab)
                docs, tokens = docs + len(texts), tokens + len(flat)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], [f.split()[0] for f in MANIFEST.split(", ")])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        for c in batch.column(0):
            total = total + np.frombuffer(zlib.decompress(c.as_py()), np.int64)
    if not isinstance(total, int):
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])


def write_file(sink, batches: Iterator[tuple[pa.Array, pa.Array]], lengths: np.ndarray, start: int) -> tuple[int, int]:
    """One file of (doc_ids, packed ids) batches; its documents and tokens."""
    bits, ids, known, sizes, checks, tokens = BitWriter(lengths), [], [], [], [], 0
    for doc_ids, packed in batches:
        ids.append(pc.fill_null(doc_ids, 0).to_numpy())
        known.append(doc_ids.is_valid().to_numpy(zero_copy_only=False))
        edges = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] // 2
        sizes.append(np.diff(edges))
        flat = np.frombuffer(packed.buffers()[2], "<u2")[edges[0] : edges[-1]]
        for lo in range(0, len(flat), 1 << 16):
            part = flat[lo : lo + (1 << 16)]
            at = bits.add(part)
            checks.append(at[(-tokens) % BLOCK :: BLOCK].copy())
            tokens += len(part)
    ids, known, sizes = (np.concatenate([*x, np.empty(0, t)]) for x, t in ((ids, np.int64), (known, bool), (sizes, np.int32)))
    stream = bits.finish()
    sections = [zlib.compress(lengths.tobytes(), 6), np.packbits(known).tobytes(), ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), np.concatenate([*checks, np.empty(0, np.int64)]).astype("<u8").tobytes(), stream]
    head = json.dumps({"docs": len(ids), "tokens": tokens, "start": start, "bits": bits.bits, "block": BLOCK, "sections": [len(s) for s in sections]}).encode()
    sink.write(MAGIC + struct.pack("<I", len(head)) + head)
    for s in sections:
        sink.write(s)
    return len(ids), tokens


def read_file(raw: bytes, slice_blocks: int = 1024) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int]]:
    """Runs of documents: their ids (an array with nulls), sizes, tokens, and the number of tokens before the run."""
    if not raw.startswith(MAGIC):
        raise ValueError("not a file of this format")
    (n,) = struct.unpack_from("<I", raw, len(MAGIC))
    at = len(MAGIC) + 4 + n
    head = json.loads(raw[len(MAGIC) + 4 : at])
    cut = np.concatenate([[0], np.cumsum(head["sections"])]) + at
    part = [memoryview(raw)[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    lengths = np.frombuffer(zlib.decompress(part[0]), np.uint8)
    known = np.unpackbits(np.frombuffer(part[1], np.uint8))[: head["docs"]].astype(bool)
    ids, sizes = np.frombuffer(part[2], "<i8"), np.frombuffer(part[3], "<u4").astype(np.int64)
    checks = np.frombuffer(part[4], "<u8").astype(np.int64)
    symbol, size = decode_table(lengths)
    stream = np.frombuffer(part[5], np.uint8)
    ends, before, held, doc = np.cumsum(sizes), head["start"], np.empty(0, np.uint16), 0
    for lo in range(0, len(checks), slice_blocks):
        c = checks[lo : lo + slice_blocks]
        counts = np.full(len(c), head["block"])
        if lo + slice_blocks >= len(checks):
            counts[-1] = head["tokens"] - head["block"] * (len(checks) - 1)
        last = checks[lo + slice_blocks] if lo + slice_blocks < len(checks) else head["bits"]
        piece = np.concatenate([stream[: int(last >> 3) + 1], np.zeros(8, np.uint8)]) if lo == 0 else np.concatenate([stream[int(c[0] >> 3) : int(last >> 3) + 1], np.zeros(8, np.uint8)])
        shift = 0 if lo == 0 else int(c[0] >> 3) * 8
        held = np.concatenate([held, decode_blocks(piece, c - shift, counts, symbol, size)])
        done = int(np.searchsorted(ends, min(head["tokens"], (lo + len(c)) * head["block"]), "right"))
        if done > doc:
            n = int(sizes[doc:done].sum())
            yield pa.array(ids[doc:done], mask=~known[doc:done]), sizes[doc:done], held[:n], before
            held, before, doc = held[n:], before + n, done


RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode(documents: DataFrame, folder: str, path: str, end: int = END) -> DataFrame:
    """Writes documents (doc_id, text) as coded files in the folder; the manifest: part, path, start, docs, tokens.

    There are as many files as the input has partitions, so a file's size is bounded as theirs is.
    """
    spark: SparkSession = documents.sparkSession
    from tokenizers import Tokenizer

    vocab = max(Tokenizer.from_file(path).get_vocab_size(), end + 1)
    assert vocab <= 1 << 16
    waiting = common.scratch(spark, "ids")
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chosen.rdd.getNumPartitions())
    dealt = chosen.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = common.materialize(dealt.mapInArrow(_tokenize(waiting, path, end, vocab), MANIFEST), "ids-manifest")
    counts = np.zeros(vocab, np.int64)
    for r in manifest.select("counts").mapInArrow(_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    sent = spark.sparkContext.broadcast(code_lengths(counts))
    rows, start = [], 0
    for r in manifest.select("part", "path", "tokens").orderBy("part").collect():
        rows.append((r.part, r.path, start))
        start += r.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        source, _ = common.filesystem(waiting)
        target, top = common.filesystem(folder)
        for batch in batches:
            for part, name, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target.create_dir(top, recursive=True)
                out = f"{top}/{uuid.uuid4().hex}.huf"
                with source.open_input_file(name) as f, target.open_output_stream(out) as sink:
                    reader = pa.ipc.open_file(f)
                    parts = (reader.get_batch(i) for i in range(reader.num_record_batches))
                    docs, tokens = write_file(sink, ((b.column(0), b.column(1)) for b in parts), sent.value, before)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out]), pa.array([before], pa.int64()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())], ["part", "path", "start", "docs", "tokens"])

    tasks = spark.createDataFrame(rows, "part int, path string, start long")
    coded = tasks.repartition(max(1, len(rows))).mapInArrow(run, "part int, path string, start long, docs long, tokens long")
    done = common.materialize(coded, "huf-manifest")
    common.remove(spark, waiting)
    return done


def decode(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        source, _ = common.filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with source.open_input_file(name) as f:
                    raw = f.read()
                for ids, sizes, tokens, before in read_file(raw):
                    wide, edges = tokens.astype("<u4"), np.concatenate([[0], np.cumsum(sizes)])
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
                    yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(edges[:-1] + before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = manifest.count()
    return manifest.select("path").repartition(max(1, n)).mapInArrow(run, RESULT)


def op7_token_store(spark, sf_dir: str) -> DataFrame:
    """The query: all documents written as coded files, and read back from them."""
    folder = common.scratch(spark, "tokens")
    return decode(encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), folder, vocabulary()), folder)
