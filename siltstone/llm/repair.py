"""Problem 4: Re-Pair grammars over token sequences, for many files at a time.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new rule
until no pair occurs twice. Here each round replaces, in all files at once,
every pair that is a local maximum of a priority, and a rule's name is the hash
of its two symbols, so a rule has the same name wherever it is inferred.

Two grammars are inferred. In a file's own grammar the tokens are reduced to
their shape and the priority is the pair's frequency in the file: a low
``ratio`` of grammar to text means high rule reuse. In the common grammar the
tokens are taken as they are and the priority is a hash of the pair, which
makes the same choice for the same passage in any file and repository: its
long rules can be compared across repositories.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

TOKEN = re.compile(
    r"#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/|\'\'\'[\s\S]*?\'\'\'|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
    r"|\d[\w.+/=]*|[A-Za-z_$][\w$]{0,38}(?![\w$+/])|[A-Za-z0-9+/]{40,}={0,2}|[A-Za-z_$][\w$]*|[^\s\w]|\w"
)
KEYWORDS = frozenset(
    "def class return if elif else for while in not and or try except finally with as import from raise lambda yield pass break continue None True False async await function var let const new this "
    "switch case default throw catch typeof export require module do done then fi esac local echo null true false".split()
)
VALUE = frozenset("None True False null true false Object freeze".split())
COMMENT, WORD, PUNCT, MARK, STRING, NUMBER, CONSTANT = range(7)  # MARK: punctuation of literals
LONG = 40  # tokens that a rule of the common grammar must span to be compared

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _M1 + (b ^ (b >> np.uint64(29))) * _M2
    h ^= h >> np.uint64(32)
    h *= _M1
    return h ^ (h >> np.uint64(29))


class Vocabulary(dict):
    """Token -> number; for each number the token's hash, the hash of its shape, its kind and length."""

    def __init__(self) -> None:
        self.hash: list[int] = []
        self.shape: list[int] = []
        self.kind: list[int] = []
        self.size: list[int] = []

    def __missing__(self, t: str) -> int:
        f, n = t[0], len(t)
        digest = xxhash.xxh3_64_intdigest
        shape = t
        if f == "#" or f == "/" and t[1:2] in ("/", "*") and n > 1:
            k, shape = COMMENT, ""
        elif f in "\"'`" and n > 1 or n >= 40:
            k, shape = STRING, "s"
        elif f.isdigit():
            k, shape = NUMBER, "0"
        elif f.isalpha() or f in "_$":
            k = CONSTANT if t in VALUE else WORD
            shape = t if t in KEYWORDS else "n"
        else:
            k = MARK if f in ",:[]{}()-+" else PUNCT
        i = self[t] = len(self.hash)
        self.hash.append(digest(t))
        self.shape.append(digest(shape))
        self.kind.append(k)
        self.size.append(0 if k == COMMENT else n)
        return i


class Batch:
    """The tokens of some files in one array, without comments."""

    def __init__(self, texts: list[str]):
        v = Vocabulary()
        ids: list[int] = []
        ends = []
        for t in texts:
            toks = TOKEN.findall(t)
            ids += [v[x] for x in toks]
            ends.append(len(ids))
        n = len(texts)
        i = np.array(ids, dtype=np.int64)
        f = np.repeat(np.arange(n), np.diff([0, *ends]))
        kind = np.array(v.kind, dtype=np.int8)[i] if len(i) else np.zeros(0, np.int8)
        keep = kind != COMMENT
        i, f, kind = i[keep], f[keep], kind[keep]
        self.file, self.n_files = f, n
        self.raw = np.array(v.hash, dtype=np.uint64)[i] if len(i) else np.zeros(0, np.uint64)
        self.shape = np.array(v.shape, dtype=np.uint64)[i] if len(i) else np.zeros(0, np.uint64)
        size = np.array(v.size, dtype=np.int64)[i] if len(i) else np.zeros(0, np.int64)
        self.tokens = np.bincount(f, minlength=n)
        self.chars = np.bincount(f, weights=size, minlength=n)
        # characters in runs of literals: strings, numbers, constants and the marks between them
        data = kind >= MARK
        edge = np.ones(len(i), dtype=bool)
        edge[1:] = (f[1:] != f[:-1]) | (data[1:] != data[:-1])
        at = np.flatnonzero(edge)
        if len(at):
            run = np.add.reduceat(size, at)
            big = data[at] & (run >= 60)
            self.literal = np.bincount(f[at][big], weights=run[big], minlength=n)
        else:
            self.literal = np.zeros(n)


def _choose(prio: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Positions whose pair is replaced: local maxima; in a row of equals every second one."""
    n = len(prio)
    prio = np.where(same, prio, 0)
    left = np.concatenate(([np.uint64(0)], prio[:-1]))
    right = np.concatenate((prio[1:], [np.uint64(0)]))
    peak = (prio > 0) & (prio >= left) & (prio >= right)
    start = peak & ~np.concatenate(([False], peak[:-1]))
    at = np.arange(n)
    since = at - np.maximum.accumulate(np.where(start, at, -1))
    return peak & (since % 2 == 0)


def _replace(x: np.ndarray, f: np.ndarray, w: np.ndarray, take: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = np.flatnonzero(take)
    x, w = x.copy(), w.copy()
    x[k] = names[k]
    w[k] += w[k + 1]
    keep = np.ones(len(x), dtype=bool)
    keep[k + 1] = False
    return x[keep], f[keep], w[keep]


def own_grammar(x: np.ndarray, f: np.ndarray, n_files: int) -> np.ndarray:
    """Size of each file's own grammar (rules and what is left of the text, in symbols) by its number of tokens.

    Rounds go on until no pair occurs twice in its file.
    """
    total = np.bincount(f, minlength=n_files)
    rules = np.zeros(n_files)
    w = np.ones(len(x), dtype=np.int64)
    while len(x) > 1:
        names = _mix(x[:-1], x[1:])
        same = f[:-1] == f[1:]
        key = _mix(names, f[:-1].astype(np.uint64))
        _, inv, count = np.unique(key, return_inverse=True, return_counts=True)
        count = count[inv]
        prio = np.where(count >= 2, (count.astype(np.uint64) << np.uint64(40)) | (names >> np.uint64(24)), np.uint64(0))
        take = np.append(_choose(prio, same), False)
        if not take.any():
            break
        used = np.unique(np.stack((f[take].astype(np.uint64), np.append(names, np.uint64(0))[take])), axis=1)
        rules += np.bincount(used[0].astype(np.int64), minlength=n_files)
        x, f, w = _replace(x, f, w, take, np.append(names, np.uint64(0)))
    left = np.bincount(f, minlength=n_files)
    return np.divide(left + 2 * rules, np.maximum(total, 1))


def common_rules(x: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules of the common grammar when they first span ``LONG`` tokens: (file, name, tokens)."""
    w = np.ones(len(x), dtype=np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(x) > 1:
        names = _mix(x[:-1], x[1:])
        # a hash other than the name's own order, so that no symbol is favoured
        prio = (names * _M2) >> np.uint64(1)
        take = np.append(_choose(prio, f[:-1] == f[1:]), False)
        if not take.any():
            break
        x, f, w = _replace(x, f, w, take, np.append(names, np.uint64(0)))
        long = w >= LONG
        if long.any():
            out.append((f[long], x[long], w[long]))
            # what is emitted takes no further part; its neighbours must not join across it
            f = np.where(long, -1 - np.arange(len(f)), f)
            keep = np.ones(len(f), dtype=bool)
            x, f, w = x[keep], f[keep], w[keep]
            w = np.where(f < 0, 0, w)
    if not out:
        e = np.zeros(0, dtype=np.int64)
        return e, e.astype(np.uint64), e
    return tuple(np.concatenate(c) for c in zip(*out))  # type: ignore[return-value]
