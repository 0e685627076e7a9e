"""Tokenizing with a cache of white-space delimited chunks.

Both vocabularies used here cut a text into pre-tokens before BPE, and no pre-token runs from a
non-space character into white space.  A text is therefore encoded exactly by encoding its chunks
(white space before a word, and the word) one by one, and a chunk by encoding its pre-tokens.  The
words of many texts are split and numbered by Arrow; the tokenizers library's BPE model encodes each distinct
pre-token once per Python worker, and the ids of whole texts are gathered by the numbers of their chunks.
Texts that hold an added token of the vocabulary (``<|endoftext|>`` and the like, which the library takes out
before it cuts anything) are encoded whole by the library.  Beyond ``max_entries`` chunks the half that came
last is dropped, so memory is bounded.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# The characters with the Unicode property White_Space.
WHITE_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The pre-token patterns of the two vocabulary files.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

_WITH_SPACE = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_WORDS = re.compile(f"[^{WHITE_SPACE}]+")
#: Texts (RE2 syntax) whose white space is more than single spaces and line feeds between words.
_ODD = r"[\t\v\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$"
#: Letters of these blocks have one-to-one lower case and no compositions to wait for.
_PLAIN = re.compile("[\x21-\x7e\xa1-įı-ɏ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTER = _byte_letters()
#: Stands between pre-tokens while their bytes are turned into letters; no text that Arrow holds has it.
_BETWEEN = "\ud800"


def _as_letters(pieces: list[str]) -> list[str]:
    """The pre-tokens in the letters of byte-level vocabularies."""
    if not pieces:
        return []
    turn = lambda s: s.encode("utf-8", "surrogatepass").decode("latin-1").translate(_LETTER)
    return turn(_BETWEEN.join(pieces)).split(turn(_BETWEEN))


class ChunkTokenizer:
    """Encodes texts to ids of 16 bits.

    keeps_space: whether the vocabulary encodes white space (byte-level BPE) or drops it and case.
    """

    def __init__(self, path: str, keeps_space: bool, max_entries: int = 800_000, longest_cached: int = 40):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Neither vocabulary normalizes its added tokens: they stand in a text as they are, or not at all.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_space = keeps_space
        self.findall = (_WITH_SPACE if keeps_space else _WORDS).findall
        self.pieces = regex.compile(BYTE_LEVEL if keeps_space else WORD_LEVEL).findall
        self.max_entries, self.longest_cached = max_entries, longest_cached
        self._clear()

    def _clear(self) -> None:
        self.count = 0  # of numbers given to chunks
        self.after_space: dict[str, int] = {}  # words after one space; with a line feed in front, words after that
        self.chunks: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.uint16), 0
        self.starts = np.zeros(1, np.int64)  # of each number, and the end of the last

    def _split(self, chunk: str) -> list[str]:
        """The chunk's pre-tokens.  Letters alone, also before a full stop or comma, need no pattern."""
        if chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha():
            return [chunk]
        if chunk[-1:] in (".", ",") and (chunk[:-1].isalpha() or chunk[0] == " " and chunk[1:-1].isalpha()):
            return [chunk[:-1], chunk[-1]]
        return self.pieces(chunk)

    def _place(self, piece: str) -> tuple[dict[str, int], str]:
        """Where a pre-token is numbered: as a chunk of its own."""
        return (self.after_space, piece[1:]) if piece[0] == " " and not piece.isspace() else (self.chunks, piece)

    def _encode_chunks(self, chunks: list[str]) -> tuple[list[bytes], dict[str, bytes]]:
        """The ids of each chunk, and those of new pre-tokens that are parts of them; the library's model takes what is new."""
        whole = {}
        if not self.keeps_space:  # a normal form may cross pre-tokens
            whole = {i: array("H", self.tokenizer.encode(c, add_special_tokens=False).ids).tobytes() for i, c in enumerate(chunks) if not _PLAIN.fullmatch(c)}
            chunks = [c.lower() for c in chunks]
        split = [[] if i in whole else self._split(c) for i, c in enumerate(chunks)] if whole else list(map(self._split, chunks))
        alone = {s[0] for s in split if len(s) == 1}
        got, more, stored = {}, [], len(self.starts) - 1
        for p in set(chain.from_iterable([s for s in split if len(s) > 1])).difference(alone):
            numbers, key = self._place(p)
            n = numbers.get(key, stored)
            if n < stored:
                got[p] = self.ids[self.starts[n] : self.starts[n + 1]].tobytes()
            else:
                more.append(p)
        new, tokenize = [*alone, *more], self.model.tokenize
        got.update(zip(new, [array("H", [t.id for t in tokenize(x)]).tobytes() for x in _as_letters(new)], strict=True))
        out = [got[s[0]] if len(s) == 1 else b"".join([got[p] for p in s]) for s in split]
        for i, ids in whole.items():
            out[i] = ids
        return out, {p: got[p] for p in more if len(p) <= self.longest_cached}

    def _store(self, encoded: list[bytes]) -> None:
        """The ids of the next numbers."""
        flat = np.frombuffer(b"".join(encoded), np.uint16)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        ends = self.used + np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) // 2)
        self.starts = np.concatenate([self.starts, ends])
        self.used += len(flat)

    def _number(self, numbers: dict[str, int], keys: list[str]) -> np.ndarray:
        """The numbers of keys; new ones are encoded."""
        got = list(map(numbers.get, keys))
        missing = [i for i, n in enumerate(got) if n is None]
        if missing:
            new = list(dict.fromkeys([keys[i] for i in missing]))
            numbers.update(zip(new, range(self.count, self.count + len(new)), strict=True))
            self.count += len(new)
            for i in missing:
                got[i] = numbers[keys[i]]
            encoded, more = self._encode_chunks([k if k[:1] == "\n" else " " + k for k in new] if numbers is self.after_space else new)
            for p, ids in more.items():
                place, key = self._place(p)
                if key not in place:
                    place[key] = self.count
                    self.count += 1
                    encoded.append(ids)
            self._store(encoded)
        return np.array(got, np.int64)

    def _thin(self) -> None:
        """Drops the chunks that came last: what is frequent came early."""
        if self.count <= self.max_entries and self.used <= 8 * self.max_entries:
            return
        keep = self.count // 2
        if int(self.starts[keep]) > 4 * self.max_entries:
            self._clear()
            return
        for numbers in (self.after_space, self.chunks):
            for k in list(reversed(numbers)):
                if numbers[k] < keep:
                    break
                del numbers[k]
        self.count, self.used = keep, int(self.starts[keep])
        self.starts = self.starts[: keep + 1].copy()

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of each text's ids.  Null is empty."""
        self._thin()
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        special = np.zeros(len(column), bool)
        for token in self.added:
            special |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)
        own: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(odd | special).tolist():
            text = column[i].as_py()
            if special[i]:
                own[i] = np.array([self.count])
                self.count += 1
                self._store([array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()])
            else:
                own[i] = self._number(self.chunks, self.findall(text))
        plain = column.filter(pa.array(~(odd | special))) if own else column
        plain = pc.replace_substring(plain, "\n", " \n" if self.keeps_space else " ")
        words = pc.split_pattern(plain, " ")
        edges = words.offsets.to_numpy() - words.offsets[0].as_py()
        numbered = words.flatten().dictionary_encode()
        distinct, at = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        if self.keeps_space:
            codes = self._number(self.after_space, distinct)[at]
            codes[edges[:-1]] = self._number(self.chunks, [distinct[k] for k in at[edges[:-1]].tolist()])
        else:
            codes = self._number(self.chunks, distinct)[at]
        sizes = np.diff(edges)
        if own:
            rest = iter(np.split(codes, edges[1:-1]))
            parts = [own[i] if i in own else next(rest) for i in range(len(column))]
            codes, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        first = self.starts[codes]
        n = self.starts[codes + 1] - first
        ends = np.cumsum(n)
        flat = self.ids[np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return flat, np.diff(bounds)


def slices(texts: list[str], characters: int = 2_000_000):
    """Runs of texts of about so many characters, as (start, end)."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= characters:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pieces_of(column: pa.Array, size: int = 4_000_000):
    """Runs of a string column of about so many bytes, as (start, column)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        before = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + size, "right")))
        yield at, column.slice(at, to - at)
        at = to


_loaded: dict[tuple, ChunkTokenizer] = {}


def tokenizer(path: str, keeps_space: bool) -> ChunkTokenizer:
    """One per Python worker."""
    key = (path, keeps_space)
    if key not in _loaded:
        _loaded[key] = ChunkTokenizer(path, keeps_space)
    return _loaded[key]


def release() -> None:
    """Lets go of this worker's caches; Spark reuses Python workers for tasks of other operators."""
    _loaded.clear()
