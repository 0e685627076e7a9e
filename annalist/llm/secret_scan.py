"""Operator 6: secret scans by patterns and a linear-chain conditional random field.

Three fixed patterns give the base spans.  A linear-chain CRF adds spans: it tags every token (run of
the secret alphabet) as secret begin (B), inside (I) or outside (O) from its shape, the neighbouring
words and characters and whether it stands in a key block, and is decoded by Viterbi.  Tokens with
only white space between them stand in one chain.

Features and scores of all tokens of many texts are computed at once.  A token whose O outweighs
whatever B or I could gain there, with the best that its neighbours and the transitions may add, is O
on every best path (``Crf.open``); chains are cut at such tokens, and Viterbi decodes the rest.  The
result is that of Viterbi over whole chains.

The CRF is trained here: on synthetic lines (fixed seed) and on all tokens of a bounded sample of
rows (``sample_rows`` texts of at most ``longest`` characters), in which tokens under base spans count
as secrets and all others do not.

Defined results: null text counts as empty; a text without secrets has zero counts, the digest of the
empty string and empty spans.  CRF spans that touch a base span are left out.  Repeated rows give
repeated results, an empty table no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordcache
from .wordcache import slices

# The base patterns, the order of kinds, and the least lengths.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS = 8, 16
_KEYWORDS = ("passw", "secret", "token", "api")

LABELS = ("O", "B", "I")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*KEY[A-Z ]*-----(.*?)(?=-----END|\Z)", re.S)
_UPPER, _LOWER, _DIGIT, _MARKS = (np.frombuffer(x, np.uint8) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"+/_.=-"))


def _of(size: int, *groups: tuple, dtype=np.uint8) -> np.ndarray:
    out = np.zeros(size, dtype)
    for characters, value in groups:
        out[np.frombuffer(characters, np.uint8) if isinstance(characters, bytes) else characters] = value
    return out


# Characters are bytes here: ASCII as it is, 128 for other characters, 129 for other white space.
_BYTE = np.full(0x110000, 128, np.uint8)
_BYTE[:128] = np.arange(128)
_BYTE[[i for i in range(128, 0x110000) if chr(i).isspace()]] = 129
_SPACES = [i for i in range(128) if chr(i).isspace()] + [129]
_KIND = _of(130, (_UPPER, 1), (_LOWER, 2), (_DIGIT, 3), (_MARKS, 4))
_MARK = _of(130, *((bytes([c]), 1 << i) for i, c in enumerate(_MARKS)))
_BREAK = _of(130, (np.arange(130), 1), (np.flatnonzero(_KIND), 0), (_SPACES, 0))
_NEAR = _of(130, (np.arange(130), 9), (b"\0", 0), (_SPACES, 1), (b"\n\r", 2), (b"\"'`", 3), (b":", 4), (b"=", 5), (b",;", 6), (b"([{<", 7), (b")]}>", 8))
_LETTER = _of(130, (_UPPER, 1), (_LOWER, 1), (b"_", 1))
_FOLD = _of(130, (np.arange(130), np.arange(130)), (_UPPER, _LOWER))
_COUNTS = _of(130, (_UPPER, 1), (_LOWER, 1 << 21), (_DIGIT, 1 << 42), dtype=np.int64)
_OTHERS = _of(130, (b"aeiouyAEIOUY", 1), (b".", 1 << 21), dtype=np.int64)
_LONG = np.array([2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 32, 36, 40, 41, 48, 64, 65, 100])
_HASHED = 1 << 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def admitted(text: str) -> list[tuple[int, int]]:
    """Spans of all tokens: every one is tagged."""
    return [m.span() for m in _TOKEN.finditer(text)]


def runs(text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Tokens with only white space between them stand in one chain."""
    out: list[list[tuple[int, int]]] = []
    for t in tokens:
        if out and not text[out[-1][-1][1] : t[0]].strip():
            out[-1].append(t)
        else:
            out.append([t])
    return out


def _mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint32)
    for p in parts:
        h = (h ^ p.astype(np.uint32)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h


class Tokens:
    """All tokens of texts, in order: their text, place, whether a chain starts there, and features (a column each)."""

    def __init__(self, texts: list[str]):
        base = np.cumsum([2, *(len(t) + 2 for t in texts)])
        b = _BYTE[np.frombuffer("\0\0{}\0\0".format("\0\0".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)]
        kind = _KIND[b]
        inside = kind > 0
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        s, e = edges[::2], edges[1::2]
        self.owner = np.searchsorted(base, s, "right") - 1
        at = base[self.owner]
        self.start, self.end = s - at, e - at
        self.columns: list[np.ndarray] = []
        self.first = np.ones(len(s), bool)
        self.size = 0
        if len(s):
            breaks = np.cumsum(_BREAK[b], dtype=np.int32)
            self.first[1:] = (breaks[s[1:]] != breaks[e[:-1] - 1]) | (self.owner[1:] != self.owner[:-1])
        self._features(texts, base, b, kind, edges, s, e, at)

    def _add(self, values: np.ndarray, size: int) -> None:
        self.columns.append(values.astype(np.int32) + np.int32(self.size))
        self.size += size

    def _features(self, texts, base, b, kind, edges, s, e, at) -> None:
        n = e - s
        over = lambda ufunc, x: ufunc.reduceat(x, edges)[::2] if len(s) else np.zeros(0, x.dtype)
        low = (1 << 21) - 1
        counts, others = over(np.add, _COUNTS[b]), over(np.add, _OTHERS[b])
        upper, lower, digit, vowels, dots = counts & low, counts >> 21 & low, counts >> 42, others & low, others >> 21
        pairs = np.zeros(len(b), np.int64)  # changes of the kind of character, and equal neighbours, within tokens
        pairs[1:] = (kind[1:] != kind[:-1]) + ((b[1:] == b[:-1]).astype(np.int64) << 32)
        pairs[s] = 0
        pairs = over(np.add, pairs)
        changes, same = pairs & 0xFFFFFFFF, pairs >> 32
        marks = over(np.bitwise_or, _MARK[b])
        long = np.searchsorted(_LONG, n, "right")
        part = lambda x, *edges: np.searchsorted(np.array(edges), x / n, "right")
        case = (upper > 0) + 2 * (lower > 0) + 4 * (digit > 0) + 8 * (marks > 0)
        ahead = [np.where(s + i < e, kind[np.minimum(s + i, len(b) - 1)], 0).astype(np.int64) for i in range(5)]
        pre = [np.where(s + i < e, b[np.minimum(s + i, len(b) - 1)], 0) for i in range(3)]
        near, near2, after = (_NEAR[b[x]].astype(np.int64) for x in (s - 1, s - 2, e))
        # The two words before the token, by their first and last letters and length.
        word = np.flatnonzero(np.diff(_LETTER[b])) + 1
        ws, we = word[::2], word[1::2]
        names = _mixed(we - ws, *(np.where(ws + i < we, _FOLD[b[np.minimum(ws + i, len(b) - 1)]], 0) for i in range(4)), _FOLD[b[we - 1]], _FOLD[b[np.maximum(ws, we - 2)]])
        w = np.searchsorted(we, s, "right") - 1
        before = []
        for i in (w, w - 1):
            ok = (i >= 0) & (len(ws) > 0)
            j = np.where(ok, i, 0)
            ok = ok & (ws[j] >= at) & (s - we[j] <= 60) if len(ws) else ok
            before.append(np.where(ok, names[j], 0) if len(ws) else np.zeros(len(s), np.uint32))
        gap = np.minimum(s - (we[np.maximum(w, 0)] if len(ws) else 0), 6).clip(0)
        signs = np.zeros(len(s), np.int64)  # whether : or = stands in the three characters before
        for i in (1, 2, 3):
            c = b[np.maximum(s - i, 0)]
            signs |= (c == 58) + 2 * (c == 61)
        shift = lambda x, k: np.where(self.first if k > 0 else np.append(self.first[1:], True)[: len(s)], 0, np.roll(x, k)) if len(s) else x
        block = np.zeros(len(s), np.int64)
        for i, t in enumerate(texts):
            if "-----BEGIN" in t:
                for m in _BLOCK.finditer(t):
                    block[np.searchsorted(s, base[i] + m.start(1)) : np.searchsorted(s, base[i] + m.end(1))] = 1
        changed = part(changes, 0.1, 0.2, 0.3, 0.45, 0.6)
        self._add(np.zeros(len(s)), 1)
        self._add(long, 19)
        self._add(part(digit, 0.05, 0.15, 0.3, 0.5, 0.75, 1) * 16 + case, 7 * 16)
        self._add(marks, 64)
        self._add((((ahead[0] * 5 + ahead[1]) * 5 + ahead[2]) * 5 + ahead[3]) * 5 + ahead[4], 5**5)
        self._add(_mixed(*pre) % _HASHED, _HASHED)
        self._add((changed * 19 + long) * 16 + case, 6 * 19 * 16)
        self._add(part(same, 0.15, 0.3, 0.5) * 4 + np.minimum(dots, 3), 16)
        self._add(part(vowels, 0.1, 0.2, 0.3, 0.5) * 16 + case, 5 * 16)
        self._add(near2 * 10 + near, 100)
        self._add(after, 10)
        self._add(before[0] % _HASHED, _HASHED)
        self._add(before[1] % _HASHED, _HASHED)
        self._add(_mixed(before[0], case, np.minimum(long, 8)) % _HASHED, _HASHED)
        self._add(_mixed(before[0], signs, gap, case) % _HASHED, _HASHED)
        self._add((signs * 16 + case) * 19 + long, 4 * 16 * 19)
        self._add((block * 16 + case) * 19 + long, 2 * 16 * 19)
        self._add(shift(long, 1) * 16 + shift(case, 1), 19 * 16)
        self._add(shift(long, -1) * 16 + shift(case, -1), 19 * 16)
        self._add(self.first * 10 + near, 20)

    def rows(self, which=slice(None)) -> np.ndarray:
        """Features of these tokens, a row each."""
        return np.stack([c[which] for c in self.columns], axis=1)


SPACE = Tokens([""]).size


def features(text: str, chain: list[tuple[int, int]], k: int, more: list[int]) -> list[int]:
    """Features of the chain's k-th token, and further ones."""
    t = Tokens([text])
    return [*t.rows([int(np.searchsorted(t.start, chain[k][0]))])[0].tolist(), *more]


class Crf:
    """Weights of a linear chain: state features by label, and transitions.  I cannot follow O or start a chain."""

    def __init__(self):
        self.state = np.zeros((SPACE, 3))
        self.step = np.zeros((3, 3))
        self.forbidden = np.zeros((3, 3))
        self.forbidden[0, 2] = -1e9
        self.start = np.array([0.0, 0.0, -1e9])

    def scores(self, chain) -> np.ndarray:
        return self.state[np.asarray(chain)].sum(axis=1)

    def open(self, tokens: Tokens) -> np.ndarray:
        """Whether B or I is possible on a best path; all other tokens are O on each.

        Turn such a token to O, and I after it (which cannot follow O) to B: at most three transitions
        change.  Where that raises every path's score, no best path has B or I there.
        """
        over = np.ascontiguousarray((self.state[:, 1:] - self.state[:, :1]).astype(np.float32)).view(np.complex64).ravel()
        score = np.zeros(len(tokens.start), np.complex64)
        for c in tokens.columns:
            score += over[c]
        b, i = score.real, score.imag
        ends = np.append(tokens.first[1:], True)[: len(b)]
        follow = np.where(ends, 0, np.maximum(np.roll(i - b, -1), 0)) if len(b) else b
        most = self.step[self.forbidden == 0]
        return np.maximum(b, i) + follow + 3 * (most.max() - most.min()) + 0.01 >= 0

    def viterbi(self, chain, after: bool = False, before: bool = False) -> list[int]:
        """The best labels; after, before: whether an O stands in the same chain before and behind."""
        s, back = self.scores(chain), []
        best = s[0] + (self.step[0] + self.forbidden[0] if after else self.start)
        for row in s[1:]:
            options = best[:, None] + self.step + self.forbidden
            back.append(options.argmax(axis=0))
            best = options.max(axis=0) + row
        best = best + self.step[:, 0] if before else best
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def marginals(self, chain: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels and of label pairs, by forward-backward."""
        s, t = self.scores(chain), self.step + self.forbidden
        n = len(s)
        fore, aft = np.zeros((n, 3)), np.zeros((n, 3))
        fore[0] = s[0] + self.start
        for i in range(1, n):
            fore[i] = s[i] + np.logaddexp.reduce(fore[i - 1][:, None] + t, axis=0)
        for i in range(n - 2, -1, -1):
            aft[i] = np.logaddexp.reduce(t + (s[i + 1] + aft[i + 1])[None, :], axis=1)
        z = np.logaddexp.reduce(fore[-1])
        pairs = sum((np.exp(fore[i - 1][:, None] + t + (s[i] + aft[i])[None, :] - z) for i in range(1, n)), np.zeros((3, 3)))
        return np.exp(fore + aft - z), pairs

    def fit(self, data: list[tuple[np.ndarray, list[int]]], epochs: int = 60, rate: float = 0.25, decay: float = 0.02, every: int = 10, settled: float = 0.002) -> Crf:
        """Gradient steps (AdaGrad) over chains at once, in step by place in the chain; features are renumbered densely.

        Every ``every`` steps all chains are seen; in between those whose probabilities are off by less than
        ``settled`` are passed over, since they add nothing to the gradient.
        """
        data = sorted((d for d in data if len(d[1])), key=lambda d: -len(d[1]))
        if not data:
            return self
        lengths = np.array([len(y) for _, y in data])
        first = np.cumsum(lengths) - lengths
        used, number = np.unique(np.concatenate([f for f, _ in data]), return_inverse=True)
        number, labels = number.reshape(int(lengths.sum()), -1).astype(np.int32), np.concatenate([y for _, y in data])

        def laid_out(chains: np.ndarray) -> tuple:
            """Features and labels by place, then chain (longest first); bounds of places, and the chain of each token."""
            alive = [int((lengths[chains] > t).sum()) for t in range(lengths[chains].max(initial=0))]
            order = np.concatenate([first[chains[:n]] + t for t, n in enumerate(alive)])
            truth, at = labels[order], np.concatenate([[0], np.cumsum(alive)])
            want = np.zeros((3, 3))
            for t in range(1, len(alive)):
                np.add.at(want, (truth[at[t - 1] : at[t - 1] + alive[t]], truth[at[t] : at[t + 1]]), 1)
            return number[order], np.eye(3)[truth], want, at, alive, np.concatenate([chains[:n] for n in alive])

        w, step = np.zeros((len(used), 3)), np.zeros((3, 3))
        seen, steps = np.full(w.shape, 1e-8), np.full((3, 3), 1e-8)
        total = lambda x: np.log(np.exp(x - (m := x.max(axis=1, keepdims=True))).sum(axis=1)) + m[:, 0]
        everything = laid_out(np.arange(len(data)))
        for epoch in range(epochs):
            if epoch % every == 0:
                flat, gold, want, at, alive, owner = everything
            s = np.zeros((len(flat), 3))
            for k in range(flat.shape[1]):
                s += w[flat[:, k]]
            move, fore, aft = step + self.forbidden, np.empty_like(s), np.zeros_like(s)
            fore[: at[1]] = s[: at[1]] + self.start
            for t in range(1, len(alive)):
                last = fore[at[t - 1] : at[t - 1] + alive[t]]
                fore[at[t] : at[t + 1]] = s[at[t] : at[t + 1]] + np.stack([total(last + move[:, y]) for y in range(3)], axis=1)
            for t in range(len(alive) - 1, 0, -1):
                following = s[at[t] : at[t + 1]] + aft[at[t] : at[t + 1]]
                aft[at[t - 1] : at[t - 1] + alive[t]] = np.stack([total(following + move[y]) for y in range(3)], axis=1)
            both = fore + aft
            z = total(both)
            g = gold - np.exp(both - z[:, None])
            pairs = np.zeros((3, 3))
            for t in range(1, len(alive)):
                x = fore[at[t - 1] : at[t - 1] + alive[t]][:, :, None] + move + (s[at[t] : at[t + 1]] + aft[at[t] : at[t + 1]])[:, None, :]
                pairs += np.exp(x - z[at[t] : at[t + 1], None, None]).sum(axis=0)
            h = -decay * w
            for y in range(3):
                h[:, y] += np.bincount(flat.ravel(), np.repeat(g[:, y], flat.shape[1]), len(used))
            seen += h * h
            w += rate * h / np.sqrt(seen)
            h = want - pairs
            steps += h * h
            step += rate * h / np.sqrt(steps)
            if epoch % every == 0:
                off = np.zeros(len(data))
                np.maximum.at(off, owner, np.abs(g).max(axis=1))
                flat, gold, want, at, alive, owner = laid_out(np.flatnonzero(off > settled)) if (off > settled).any() else everything
        self.state[used], self.step = w, step
        return self


def _synthetic(seed: int = 11, each: int = 60) -> list[tuple[str, list[tuple[int, int]]]]:
    """(text, spans of secrets): lines of a rule, for secrets and for look-alikes."""
    rng = random.Random(seed)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    both = lower + upper + digits
    words = [pick(lower, rng.randint(2, 9)) for _ in range(150)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(2, 12)))
    ensure = lambda s: s if any(c.isdigit() for c in s) else s[:-1] + "7"
    short = ["pwd = ", "pwd: ", "pass: ", "passphrase: ", "passphrase = ", "credential = ", "credentials: ", "login: ", "pin code: ", "auth = "]
    secrets = [
        lambda: ("Authorization: Bearer ", ensure(pick(both + "_-", rng.randint(30, 60)))),
        lambda: (rng.choice(["aws_secret_access_key ", "secret key is ", "access key: ", "private key "]), ensure(pick(both + "+/", 40))),
        lambda: (rng.choice(["", "pat ", "github "]), "ghp_" + ensure(pick(both, 36))),
        lambda: (rng.choice(["", "key ", "stripe "]), rng.choice(["sk-", "sk_live_", "xoxb-"]) + ensure(pick(both, rng.randint(24, 48)))),
        lambda: (rng.choice(["pwd = ", "pass: ", "credential = ", "auth: "]), ensure(pick(both + "+/_-", rng.randint(16, 32)))),
        lambda: (rng.choice(short), ensure(pick(both, rng.randint(8, 15)))),
        lambda: (rng.choice(short), rng.choice(words).capitalize() + pick(digits, rng.randint(1, 3)) + rng.choice(words)[:5] + pick(digits, 2)),
        lambda: (rng.choice(["Authorization: Bearer ", "Bearer ", "secret key is ", "access key: ", "auth: "]), pick(lower + upper, rng.randint(20, 60))),
        lambda: (rng.choice(short), pick(lower + upper, rng.randint(10, 24))),
        lambda: ("jwt ", f"eyJ{ensure(pick(both, 20))}.eyJ{pick(both, 40)}.{pick(both + '_-', 43)}"),
    ]
    clean = [
        lambda: pick(digits, 16),
        lambda: ".".join(str(rng.randint(100, 255)) for _ in range(4)) + rng.choice(["", ".", "/24", ":8080"]),
        lambda: f"{pick(lower, 6)}.{rng.randint(1, 99)}{rng.choice('@.')}mail{rng.randint(1, 9)}.example.com",
        lambda: f"www.example.com/{'/'.join(rng.choice(words) for _ in range(3))}/{rng.randint(1, 999)}.html",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T10.20.30.{pick(digits, 3)}",
        lambda: f"+{pick(digits, 2)}-{pick(digits, 3)}-{pick(digits, 4)}-{pick(digits, 4)}",
        lambda: "-".join(rng.choice(words) for _ in range(4)) + f"-{rng.randint(1, 99)}",
        lambda: f"{'_'.join(rng.choice(words) for _ in range(4))}_v{rng.randint(1, 9)}.tar.gz",
        lambda: "=" * rng.randint(8, 30) + str(rng.randint(1, 99)) + "=" * rng.randint(8, 30),
        lambda: "".join(rng.choice(words) for _ in range(4)) + str(rng.randint(1, 99)),
        lambda: ".".join(pick(digits, 3) for _ in range(6)),
        lambda: f"DE{pick(digits, 20)}",
        lambda: rng.choice([*short, "Authorization: ", "secret key is ", "access key: ", "Bearer ", "private key "]) + prose(),
        lambda: rng.choice(["the password is ", "a token of ", "pass the ", "bearer of ", "secret: ", "key "]) + prose(),
        lambda: rng.choice(words) + rng.choice(words).capitalize() + rng.choice(words).capitalize() + rng.choice(["", str(rng.randint(1, 9))]),
        lambda: rng.choice(words).capitalize() + " " + rng.choice(words).upper() + str(rng.randint(1, 99)) + " " + pick(digits, rng.randint(1, 12)),
        lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)} {pick(upper, rng.randint(2, 6))}-{pick(digits, 4)}",
        lambda: "-----BEGIN CERTIFICATE REQUEST " + prose(),
    ]
    out = []
    for make in secrets:
        for _ in range(each):
            lead, secret = make()
            text = f"{prose()}{rng.choice(['. ', chr(10), ' '])}{lead}"
            out.append((f"{text}{secret}{rng.choice([' ', chr(10), '', ', '])}{prose()}", [(len(text), len(text) + len(secret))]))
    for make in clean:
        for _ in range(each):
            out.append((f"{prose()} {rng.choice(['', '(', rng.choice(words) + ': ', chr(34)])}{make()}{rng.choice([' ', ', ', '', '###'])}{prose()}", []))
    for _ in range(each):
        letters = rng.choice([both + "+/", both + "+/", lower + upper])
        lines = [pick(letters, 64) for _ in range(rng.randint(2, 8))]
        if rng.random() < 0.8:
            lines.append(pick(letters, rng.randint(2, 60)) + rng.choice(["", "=", "=="]))
        text = f"{prose()}\n-----BEGIN RSA PRIVATE KEY-----\n"
        spans, at = [], len(text)
        for line in lines:
            spans.append((at, at + len(line)))
            at += len(line) + 1
        out.append((text + "\n".join(lines) + "\n-----END RSA PRIVATE KEY-----\n" + prose(), [(spans[0][0], spans[-1][1])]))
    return out


def _labelled(texts: list[str], spans: list[list[tuple[int, int]]], window: int = 40) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Features and labels of every chain, of its parts from about ``window`` tokens on (never before an I)."""
    tokens = Tokens(texts)
    labels, last = [], None
    for owner, s, e, first in zip(tokens.owner.tolist(), tokens.start.tolist(), tokens.end.tolist(), tokens.first.tolist(), strict=True):
        inside = next(((owner, x) for x in spans[owner] if s < x[1] and x[0] < e), None)
        labels.append(0 if inside is None else 2 if inside == last and not first else 1)
        last = inside
    rows, at = tokens.rows(), 0
    for i in range(1, len(labels) + 1):
        if i == len(labels) or tokens.first[i] or i - at >= window and labels[i] != 2:
            yield rows[at:i], labels[at:i]
            at = i


def train(texts: list[str]) -> Crf:
    """A model of the synthetic lines and of the sample's texts; of an assignment the value alone counts as secret."""
    made = _synthetic()
    data = list(_labelled([t for t, _ in made], [x for _, x in made]))
    for a, b in slices(texts):
        of = [[(ASSIGN.match(t, s).start(2) if k == 0 else s, e) for s, k, e in base_spans(t)] for t in texts[a:b]]
        data += _labelled(texts[a:b], of)
    return Crf().fit(data)


class Scanner:
    def __init__(self, model: Crf):
        self.model = model

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, kind, end) of all spans, by start, then kind."""
        return self.all([text])[0]

    def all(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """The spans of each text."""
        texts = [t or "" for t in texts]
        return [found for a, b in slices(texts, 500_000) for found in self._slice(texts[a:b])]

    def _slice(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        tokens, added = Tokens(texts), [[] for _ in texts]
        some = np.flatnonzero(self.model.open(tokens))
        for run in np.split(some, np.flatnonzero((np.diff(some) > 1) | tokens.first[some[1:]]) + 1) if len(some) else []:
            a, b = int(run[0]), int(run[-1]) + 1
            labels = self.model.viterbi(tokens.rows(slice(a, b)), not tokens.first[a], b < len(tokens.first) and not tokens.first[b])
            of = added[tokens.owner[a]]
            for s, e, y in zip(tokens.start[a:b].tolist(), tokens.end[a:b].tolist(), labels, strict=True):
                if y == 1:
                    of.append([s, e])
                elif y == 2:
                    of[-1][1] = e
        return [self._joined(t, x) for t, x in zip(texts, added, strict=True)]

    def _joined(self, text: str, added: list[list[int]]) -> list[tuple[int, int, int]]:
        base = base_spans(text)
        at, free = 0, []
        longest = 0  # ends of base spans do not rise with their starts across kinds
        for s, e in added:
            while at < len(base) and base[at][0] < e:
                longest = max(longest, base[at][2])
                at += 1
            if longest <= s and not any(b[0] < e and s < b[2] for b in base[max(0, at - 1) : at]):
                free.append((s, 3, e))
        return sorted(base + free)


def training_sample(documents: DataFrame, sample_rows: int = 300, longest: int = 20_000) -> list[str]:
    """Texts of at most ``sample_rows`` rows, by a hash of doc_id; each of at most ``longest`` characters."""
    usable = documents.where(F.col("doc_id").isNotNull() & (F.length("text") <= longest))
    order = F.xxhash64("doc_id")
    ids = [r.doc_id for r in usable.select("doc_id").orderBy(order, "doc_id").limit(sample_rows).collect()]
    rows = usable.select("doc_id", "text").where(F.col("doc_id").isin(ids)).orderBy(order, "doc_id", "text").limit(sample_rows).collect() if ids else []
    return [r.text for r in rows]


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(documents: DataFrame, model: Crf) -> DataFrame:
    """Counts, digest and spans for every row of documents (doc_id, text)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordcache.release()
        scanner = Scanner(sent.value)
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch.column(0).to_pylist(), scanner.all(batch.column(1).to_pylist()), strict=True):
                base = [x for x in found if x[1] < 3]
                counts = Counter(k for _, k, _ in base)
                rows.append((doc_id, counts[0], counts[1], counts[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], [f.split()[0] for f in RESULT.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span replaced (overlapping spans by one mark)."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The query: every document's spans."""
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(documents, train(training_sample(documents)))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are replaced by a mark and n_chars follows; every document stays."""
    common.bounded_batches(spark)
    sent = spark.sparkContext.broadcast(train(training_sample(docs.select("doc_id", "text"))))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordcache.release()
        scanner = Scanner(sent.value)
        for batch in batches:
            text, n = batch.column(names.index("text")).to_pylist(), None
            if "n_chars" in names:
                n = batch.column(names.index("n_chars")).to_pylist()
            for i, (t, found) in enumerate(zip(text, scanner.all(text), strict=True)):
                if found:
                    text[i] = redact(t, found)
                    if n:
                        n[i] = len(text[i])
            new = {"text": pa.array(text, pa.string())} | ({"n_chars": pa.array(n, batch.schema.field("n_chars").type)} if n is not None else {})
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names)

    return docs.mapInArrow(run, docs.schema)
