"""Operator 2: language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is cross-parsed against it:
from each place the longest match that occurs in the labelled text is one phrase (a single unknown
symbol also is one).  c phrases over n symbols estimate the cross entropy as c * log2(N) / n, with N
the length of the labelled text; the language that needs the fewest normalised phrases wins.

Symbols are lower-case letters; anything else is one separator.  The automata are walked as tables of bit
masks (sorted lists for letters beyond the most frequent), many windows of texts in step.  Windows first start
as if a phrase began there; then each is walked again from the state that the window before it ends in, until
both walks meet, so phrases are those of the whole text.

Fitting uses a bounded sample of labelled rows (``languages``, ``rows_per_language``, ``symbols_per_row``,
``symbols_per_language`` and ``symbols_in_all`` are the bounds); all texts are predicted whole.

Defined results: null text, or text without a letter, is ``und`` with score 0.  Ties go to the smaller
language name.  Without any labelled row everything is ``und``.  Only text and labels are read; other
columns do not matter.  Repeated rows give repeated results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, wordcache
from .wordcache import slices

UND = "und"
EVIDENCE = 200  # symbols of a text that may overrule its label
LEARNED = 5000  # symbols learned of a language that may be overruled
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def symbols(text: str) -> str:
    """Lower-case letters, with one space for each run of anything else."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class SuffixAutomaton:
    """All substrings of a sequence of small integers."""

    def __init__(self, sequence: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            return cur
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            self.link[cur] = q
            return cur
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = self.link[cur] = clone
        return cur

    def table(self, alphabet: int) -> Table:
        """The automaton as a table: bit masks of the first symbols, and a sorted list of the moves by others."""
        n = len(self.next)
        masks, first = np.zeros((n + 1) * _WORDS, np.uint64), np.zeros((n + 1) * _WORDS, np.int32)
        to: list[int] = []
        rare = []
        for state, moves in enumerate(self.next):
            for word in range(_WORDS):
                first[state * _WORDS + word] = len(to)
                own = sorted(c for c in moves if c >> 6 == word)
                masks[state * _WORDS + word] = sum(1 << (c & 63) for c in own)
                to += [moves[c] for c in own]
            rare += [(state * alphabet + c, moves[c]) for c in moves if c >= _MASKED]
        rare = np.array(sorted(rare), dtype=np.int64).reshape(-1, 2)
        root = np.full(alphabet, n, np.int32)
        for c, state in self.next[0].items():
            root[c] = state
        return Table(alphabet, masks, first, np.array([*to, n], np.int32) * 2, rare[:, 0].copy(), rare[:, 1].astype(np.int32) * 2, root * 2 + 1)


_WORDS = 2  # masks of 64 symbols a state
_MASKED = 64 * _WORDS


@dataclass
class Table:
    """Moves of an automaton.  A move is 2 * next state + (1 if a phrase ended before the symbol).

    State 0 is the start of a text; the last state stands for a phrase that is one unknown symbol.
    masks, first: by state and word of symbols, which symbols move on, and where their moves begin in ``to``;
    keys, values: state * alphabet + symbol -> move, for the symbols beyond the masks; root: moves by which a
    phrase ends and the next begins with a symbol.
    """

    alphabet: int
    masks: np.ndarray
    first: np.ndarray
    to: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    root: np.ndarray

    def step(self, state: np.ndarray, of: Symbols) -> np.ndarray:
        """The moves from states past the start of a text."""
        at = state * _WORDS
        at += of.word
        mask = self.masks[at]
        place = np.bitwise_count(mask & of.below).astype(np.int32)
        place += self.first[at]
        out = np.where(mask & of.bit, self.to[place], self.root[of.symbol])
        if len(of.rare):
            symbol = of.symbol[of.rare]
            found = self.root[symbol]
            if len(self.keys):
                key = state[of.rare].astype(np.int64) * self.alphabet + symbol
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = np.where(self.keys[k] == key, self.values[k], found)
            out[of.rare] = found
        return out


_BIT = np.concatenate([np.uint64(1) << np.arange(64, dtype=np.uint64)] * _WORDS)


class Symbols:
    """Symbols of many windows, with what every table needs of them."""

    def __init__(self, symbol: np.ndarray):
        masked = np.minimum(symbol, _MASKED - 1)
        self.symbol, self.word, self.bit = symbol, (masked >> 6).astype(np.int32), _BIT[masked]
        self.below = self.bit - np.uint64(1)
        self.rare = np.flatnonzero(symbol >= _MASKED)


@dataclass
class Model:
    languages: list[str]
    letters: str
    tables: list[Table]
    lengths: list[int]
    codes: np.ndarray

    @property
    def alphabet(self) -> int:
        return len(self.letters) + 2


def code_table(letters: str) -> np.ndarray:
    """Code point -> symbol: 0 a letter not in the sample, 1 no letter, else a letter of the sample."""
    known = {ord(c): i + 2 for i, c in enumerate(letters)}
    return np.array([known.get(i, 0) if chr(i).isalpha() else 1 for i in range(0x110000)], dtype=np.uint8 if len(letters) < 254 else np.int32)


def fit(sample: list[tuple[str, str]], symbols_per_row: int = 8000, symbols_per_language: int = 40_000, symbols_in_all: int = 2_000_000) -> Model:
    """A model of (text, language) rows.  The bounds keep tables small: about 2 * symbols_per_language states of 30 bytes each.

    Every letter of the sample is a symbol of its own.
    """
    texts: dict[str, list[str]] = {}
    for text, lang in sample:
        texts.setdefault(lang, []).append(symbols(text)[:symbols_per_row])
    most = min(symbols_per_language, symbols_in_all // max(1, len(texts)))
    kept = {lang: " ".join(t)[:most] for lang, t in texts.items()}
    kept = {lang: t for lang, t in sorted(kept.items()) if t}
    counts = Counter("".join(kept.values()).replace(" ", ""))
    alphabet = "".join(sorted(counts, key=lambda c: (-counts[c], c)))
    code = {c: i + 2 for i, c in enumerate(alphabet)} | {" ": 1}
    tables = [SuffixAutomaton([code.get(c, 0) for c in t]).table(len(alphabet) + 2) for t in kept.values()]
    return Model(list(kept), alphabet, tables, [len(t) for t in kept.values()], code_table(alphabet))


class Parser:
    """Counts phrases of whole texts, many windows in step."""

    def __init__(self, model: Model, window: int = 192):
        self.model, self.window, self.codes = model, window, model.codes

    def encode(self, text: str) -> np.ndarray:
        s = self.codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        sep = s == 1
        keep = ~sep
        keep[1:] |= ~sep[:-1]
        return s[keep]

    def phrases(self, encoded: list[np.ndarray]) -> np.ndarray:
        """A row for each text: its phrases by language."""
        w = self.window
        lengths = np.array([len(e) for e in encoded])
        windows = -(-lengths // w)
        owner = np.repeat(np.arange(len(encoded)), windows)
        total = int(windows.sum())
        grid = np.ones(total * w, dtype=self.codes.dtype)
        at = 0
        for e, n in zip(encoded, windows, strict=True):
            grid[at : at + len(e)] = e
            at += int(n) * w
        sizes = np.full(total, w)
        last = np.cumsum(windows) - 1
        sizes[last[windows > 0]] = (lengths - (windows - 1) * w)[windows > 0]
        order = np.argsort(-sizes, kind="stable")
        lane = np.empty(total, np.int64)
        lane[order] = np.arange(total)
        follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # windows that have one before them
        next_lane = np.full(total, -1)
        next_lane[lane[follows - 1]] = lane[follows]
        sizes, owner = sizes[order], owner[order]
        grid = np.ascontiguousarray(grid.reshape(total, w)[order].T).astype(np.int32)
        active = np.searchsorted(-sizes, -np.arange(w), side="left")  # windows longer than t
        out = np.zeros((len(encoded), len(self.model.tables)), dtype=np.int64)
        steps = [Symbols(row[:n]) for row, n in zip(grid, active, strict=True) if n]
        moves = np.zeros((w, total), np.int32)
        for k, table in enumerate(self.model.tables):
            state = np.zeros(total, dtype=np.int32)
            for t, of in enumerate(steps):
                n = len(of.symbol)
                moves[t, :n] = table.root[of.symbol] - 1 if t == 0 else table.step(state[:n], of)
                np.right_shift(moves[t, :n], 1, out=state[:n])
            self._mend(table, grid, sizes, moves, state, next_lane)
            ended = np.zeros(total, np.int64)
            for t in range(w):
                ended[: active[t]] += moves[t, : active[t]] & 1
            out[:, k] = np.bincount(owner, weights=ended, minlength=len(encoded)).astype(np.int64) + (lengths > 0)
        return out

    def _mend(self, table: Table, grid: np.ndarray, sizes: np.ndarray, moves: np.ndarray, state: np.ndarray, next_lane: np.ndarray, rounds: int = 6) -> None:
        """Walks windows again from the state before them, until the walk meets the old one; so do those after a window whose end changes."""
        open_ = np.flatnonzero(next_lane >= 0)
        for _ in range(rounds):
            lanes, now = next_lane[open_], state[open_]
            changed = []
            for t in range(self.window):
                short = sizes[lanes] <= t
                if short.any():  # ended before both walks met: the text ends there too
                    lanes, now = lanes[~short], now[~short]
                if not len(lanes):
                    break
                move = table.step(now, Symbols(grid[t, lanes]))
                apart = (move >> 1) != (moves[t, lanes] >> 1)
                moves[t, lanes] = move
                lanes, now = lanes[apart], move[apart] >> 1
            else:
                state[lanes] = now
                changed = lanes[next_lane[lanes] >= 0]
            open_ = changed
            if not len(open_):
                return
        one = np.zeros(1, np.int32)
        for start in open_.tolist():  # walks that do not meet for long: one window after the other
            at, now = next_lane[start], int(state[start])
            while at >= 0:
                for t in range(int(sizes[at])):
                    one[0] = now
                    move = int(table.step(one, Symbols(grid[t, at : at + 1]))[0])
                    met = move >> 1 == moves[t, at] >> 1
                    moves[t, at], now = move, move >> 1
                    if met:
                        break
                if met:
                    break
                state[at] = now
                at = next_lane[at]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found: list[tuple[str, float]] = [(UND, 0.0)] * len(texts)
        rows, encoded = [], []
        for i, t in enumerate(texts):
            if t and self.model.tables:
                e = self.encode(t)
                if (e != 1).any():
                    rows.append(i)
                    encoded.append(e)
        if not rows:
            return found
        n = np.array([len(e) for e in encoded])[:, None]
        bits = self.phrases(encoded) * np.log2(np.maximum(2, self.model.lengths))[None, :] / n
        best = bits.argmin(axis=1)
        share = np.exp2(-(bits - bits.min(axis=1, keepdims=True)))
        for i, b, s in zip(rows, best, (1 / share.sum(axis=1)), strict=True):
            found[i] = self.model.languages[b], float(s)
        return found


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the row belongs to the fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(documents: DataFrame, rows_per_language: int = 60, languages: int = 256, characters_per_row: int = 32_000) -> list[tuple[str, str]]:
    """(text, language) of at most so many rows per language: those of 200 characters first, by a hash of doc_id.

    Of each text at most ``characters_per_row`` are read, of languages the ``languages`` most frequent ones.
    Only ids are ranked over all rows; the texts of the rows that were picked are read afterwards.
    """
    learn = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = [r.lang for r in learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    if not known:
        return []
    order = Window.partitionBy("lang").orderBy(F.col("short"), F.xxhash64("doc_id"), "doc_id", "tie")
    ranked = lambda df: df.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows_per_language)
    rows = learn.where(F.col("lang").isin(known)).select("doc_id", "lang", (F.length("text") < 200).alias("short"), F.xxhash64("text").alias("tie"), "text")
    picked = [(r.doc_id, r.lang, r.tie) for r in ranked(rows.drop("text")).select("doc_id", "lang", "tie").distinct().collect()]
    mine = documents.sparkSession.createDataFrame(picked, rows.select("doc_id", "lang", "tie").schema)
    whole = ranked(rows.join(F.broadcast(mine), ["doc_id", "lang", "tie"], "left_semi").withColumn("text", F.substring("text", 1, characters_per_row)))
    return [(r.text, r.lang) for r in sorted(whole.select("doc_id", "text", "lang").collect(), key=lambda r: (r.doc_id * 0x9E3779B97F4A7C15 % 2**64, r.doc_id, r.text))]


def predicted(parser: Parser, column: pa.Array, rows: int = 500) -> list[tuple[str, float]]:
    got: list[tuple[str, float]] = []
    for lo in range(0, len(column), rows):
        texts = column.slice(lo, rows).to_pylist()
        for a, b in slices([t or "" for t in texts]):
            got += parser.predict(texts[a:b])
    return got


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents (doc_id, text)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordcache.release()
        parser = Parser(sent.value)
        for batch in batches:
            got = predicted(parser, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """The query: every document, with a model of the rows that are not held out."""
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(documents, fit(labelled_sample(documents)))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without any letter go; lang becomes the language that most of the text is in.

    Every whole text is predicted.  The prediction replaces a null lang, and a label where the text has ``EVIDENCE`` symbols or
    more, the predicted language outweighs all others together (score over a half) and at least ``LEARNED`` symbols
    of the label's own language were learned; else the label stays.  mix_sources takes a source's words by lang.
    Without a model (no usable labelled row outside the held-out fold) null stays null.  Null and empty texts have no
    letter; repeated rows and ties are treated row by row, an empty table stays empty, extra columns pass as they are.
    """
    common.bounded_batches(spark)
    usable = docs.select("doc_id", "text", "lang")
    model = fit(labelled_sample(usable))
    sent, has_model = spark.sparkContext.broadcast(model), bool(model.languages)
    learned = {x for x, n in zip(model.languages, model.lengths, strict=True) if n >= LEARNED}
    schema = docs.schema

    def settled(text: str, label: str | None, found: tuple[str, float]) -> str:
        overruled = label is None or label != found[0] and label in learned and found[1] > 0.5 and len(symbols(text)) >= EVIDENCE
        return found[0] if overruled else label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordcache.release()
        parser = Parser(sent.value)
        for batch in batches:
            at = {name: batch.schema.get_field_index(name) for name in ("text", "lang")}
            batch = batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in batch.column(at["text"]).to_pylist()], pa.bool_()))
            labels = batch.column(at["lang"])
            if has_model:
                texts = batch.column(at["text"])
                labels = pa.array([settled(*x) for x in zip(texts.to_pylist(), labels.to_pylist(), predicted(parser, texts), strict=True)], labels.type)
                batch = batch.set_column(at["lang"], batch.schema.field(at["lang"]), labels)
            yield batch

    return docs.mapInArrow(run, schema)
