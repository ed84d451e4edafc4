"""Problem 7: multi-pattern search after Wu and Manber, over words and over characters.

Patterns are blocks of test items, cut so that any passage that counts must
hold one of them unchanged. ``shift`` tells for a pair of neighbouring symbols
how far the window may move on; pairs that end a pattern select a bucket by
hash, and its patterns are compared directly. Each occurrence is then extended
on both sides as far as the allowed edits reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

WORD_RUN = 24  # words of an English passage
EDITS_PER = 12  # one word in so many may be changed, dropped or added
CHAR_RUN = 45  # characters of a Chinese passage

#: tags of any length, also over several lines; a lone ``<`` is punctuation
TAG = re.compile(
    r"""</?(?P<name>[A-Za-z][\w:\-]*+)(?:\s++[\w:@.\-]++(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]++))?)*+\s*/?>|<!--(?:(?!<!--)[\s\S])*?-->|<[A-Za-z][A-Za-z0-9+.\-]*+:[^\s<>]*+>"""
    r"""|\]\((?:[^()\s]|\([^()\s]*+\))*+(?:\s++"[^"\n]*+")?\s*+\)|&(?:amp|lt|gt|quot|nbsp|#\d+);|[\u200b-\u200f\u2060\ufeff\u00ad]"""
)
BLOCK = frozenset("p br div li ul ol td th tr table h1 h2 h3 h4 h5 h6 blockquote pre hr".split())
ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt]")
SOFT = re.compile(r"(?<=\w)(?:['’‘`´*_~]+)(?=\w)")
WORD = re.compile(r"[^\W_]+")
ASCII_WORD = re.compile(r"[a-z0-9]+")
CJK = re.compile(r"[㐀-䶿一-鿿豈-﫿]")


def _gap(m: re.Match) -> str:
    name = m.group("name")
    return " " if name and name.lower() in BLOCK or m.group()[0] in "&]" else ""


def _bare(text: str) -> str:
    """Lower case without markup: inline tags and invisible characters vanish, block tags and escapes of white space separate."""
    if "\\" in text:
        text = ESCAPE.sub(lambda m: chr(int(m.group(1), 16)) if m.group(1) else " ", text)
    if "<" in text or "](" in text or "&" in text or not text.isascii():
        text = TAG.sub(_gap, text)
    return text.lower()


def words_of(text: str) -> list[str]:
    """Lower-case words; apostrophes and marks inside words vanish, other punctuation separates."""
    text = _bare(text)
    for c in "'’‘`´*_~":
        if c in text:
            text = SOFT.sub("", text)
            break
    return (ASCII_WORD if text.isascii() else WORD).findall(text)


def chars_of(text: str) -> str:
    """Letters and digits only, lower case."""
    return "".join(WORD.findall(_bare(text)))


class WuManber:
    """Patterns of at least ``least`` symbols; ``search`` yields (pattern number, start)."""

    def __init__(self, patterns: Sequence[Sequence[str]], least: int):
        self.patterns, self.m = patterns, least
        self.skip = least - 1  # the shift of a pair that no pattern holds
        self.shift: dict = {}
        self.bucket: dict = {}
        self.single: set = set()
        for k, p in enumerate(patterns):
            for j in range(1, least):
                pair = p[j - 1] + " " + p[j]
                s = least - 1 - j
                if self.shift.get(pair, self.skip) > s:
                    self.shift[pair] = s
                if s == 0:
                    self.bucket.setdefault(pair, []).append(k)
            self.single.update(p[:least])

    def search(self, seq: Sequence[str]) -> Iterable[tuple[int, int]]:
        m, n, shift, bucket, single, patterns, skip, whole = self.m, len(seq), self.shift, self.bucket, self.single, self.patterns, self.skip, self.m
        i = m - 1
        while i < n:
            w = seq[i]
            if w not in single:
                i += whole
                continue
            pair = seq[i - 1] + " " + w
            s = shift.get(pair, skip)
            if s:
                i += s
                continue
            at = i - m + 1
            for k in bucket[pair]:
                p = patterns[k]
                if seq[at : at + len(p)] == p:
                    yield k, at
            i += 1


def _unchanged(a: Sequence[str], b: Sequence[str], i: int, j: int, step: int) -> int:
    n, m, x = len(a), len(b), 0
    while 0 <= i < n and 0 <= j < m and a[i] == b[j]:
        i, j, x = i + step, j + step, x + 1
    return x


def _reach(a: Sequence[str], b: Sequence[str], i: int, j: int, step: int, most: int) -> list[int]:
    """For 0, 1, ... ``most`` edits: how many symbols of ``a`` beyond i can be aligned with ``b`` beyond j.

    ``step`` 1 goes right (i, j are the next symbols), -1 left. Furthest-reaching diagonals.
    """
    n, m = len(a), len(b)

    def slide(x: int, y: int) -> int:
        while 0 <= i + step * x < n and 0 <= j + step * y < m and a[i + step * x] == b[j + step * y]:
            x += 1
            y += 1
        return x

    front = {0: slide(0, 0)}
    out = [front[0]]
    for _ in range(most):
        nxt: dict[int, int] = {}
        for d, x in front.items():  # d: symbols of b less those of a
            for dx, dd in ((1, 0), (1, -1), (0, 1)):  # changed, dropped, added
                x2, y2 = x + dx, x + dx + d + dd
                if not (0 <= i + step * (x2 - 1) < n if dx else True) or (dx == 1 and dd == 0 and not 0 <= j + step * (y2 - 1) < m):
                    continue
                e = slide(x2, y2)
                if e > nxt.get(d + dd, -1):
                    nxt[d + dd] = e
        front = nxt
        if not front:
            break
        out.append(max(max(front.values()), out[-1]))
    return out


def passage(item: Sequence[str], doc: Sequence[str], p: int, q: int, length: int, run: int = WORD_RUN, per: int = EDITS_PER) -> tuple[int, int, int]:
    """Longest passage around an occurrence that counts: (words of the item, edits), (0, 0) if none does; and the words that follow the occurrence unchanged.

    A passage that counts holds one of less than two runs' length that does: cut
    it into such parts, one has no more than its share of edits. Of that part
    some words in a row, ``least``, are unchanged, with an occurrence in them.
    So an occurrence is followed as far as the edits last only if such a part
    lies around it.
    """
    least = -((run // per - run) // (run // per + 1))
    right, left = _unchanged(item, doc, p + length, q + length, 1), _unchanged(item, doc, p - 1, q - 1, -1)
    best = (0, 0)
    if right + length + left >= least:
        for most in (2 * run // per - 1, len(item) // per):
            rights = _reach(item, doc, p + length, q + length, 1, most)
            lefts = _reach(item, doc, p - 1, q - 1, -1, most)
            for x, r in enumerate(rights):
                for y, le in enumerate(lefts):
                    n = length + r + le
                    if n >= run and per * (x + y) <= n and n > best[0]:
                        best = (n, x + y)
            if not best[0]:
                break
    return (*best, right)


class Leaks:
    """The tables for one block of test items."""

    WORDS, STEP = 5, 4  # 24 words with two edits keep eight in a row: one block of 5 begins at a multiple of 4 in them
    CHARS, CSTEP = 22, 23

    def __init__(self, items: Iterable[tuple[int, str | None, str | None]]):
        self.words: list[tuple[int, list[str]]] = []
        self.chars: list[tuple[int, str]] = []
        pats, self.where, cpats, self.cwhere = [], [], [], []
        for item_id, _, text in items:
            text = text or ""
            if len(CJK.findall(text)) >= CHAR_RUN:
                c = chars_of(text)
                self.chars.append((item_id, c))
                for i in range(0, len(c) - self.CHARS + 1, self.CSTEP):
                    cpats.append(c[i : i + self.CHARS])
                    self.cwhere.append((len(self.chars) - 1, i))
            w = words_of(text)
            if len(w) >= WORD_RUN:
                self.words.append((item_id, w))
                for i in range(0, len(w) - self.WORDS + 1, self.STEP):
                    pats.append(w[i : i + self.WORDS])
                    self.where.append((len(self.words) - 1, i))
        self.by_words = WuManber(pats, self.WORDS) if pats else None
        self.by_chars = WuManber(cpats, self.CHARS) if cpats else None

    def find(self, text: str | None) -> dict[int, tuple[int, int]]:
        """item_id -> (length of the longest passage, edits)."""
        return self.find_in(*symbols_of(text))

    def find_in(self, words: list[str], chars: str) -> dict[int, tuple[int, int]]:
        out: dict[int, tuple[int, int]] = {}
        if self.by_words:
            # up to where a diagonal's words have been followed unchanged: another occurrence in them has the same passages
            followed: dict[tuple[int, int], int] = {}
            for k, at in self.by_words.search(words):
                n, i = self.where[k]
                if followed.get((n, at - i), 0) >= at + self.WORDS:
                    continue
                item_id, item = self.words[n]
                *got, unchanged = passage(item, words, i, at, self.WORDS)
                followed[n, at - i] = at + self.WORDS + unchanged
                if tuple(got) > out.get(item_id, (0, 0)):
                    out[item_id] = tuple(got)
        if self.by_chars:
            done: dict[tuple[int, int], int] = {}
            for k, at in self.by_chars.search(chars):
                n, i = self.cwhere[k]
                if done.get((n, at - i), 0) >= at + self.CHARS:
                    continue
                item_id, item = self.chars[n]
                a, b = i, i + self.CHARS
                while a > 0 and at - (i - a) > 0 and item[a - 1] == chars[at - (i - a) - 1]:
                    a -= 1
                while b < len(item) and at + b - i < len(chars) and item[b] == chars[at + b - i]:
                    b += 1
                done[n, at - i] = at + b - i
                if b - a >= CHAR_RUN and (b - a, 0) > out.get(item_id, (0, 0)):
                    out[item_id] = (b - a, 0)
        return out


def symbols_of(text: str | None) -> tuple[list[str], str]:
    """A document's words, and its characters if it has any Chinese ones."""
    if not text:
        return [], ""
    return words_of(text), chars_of(text) if not text.isascii() and CJK.search(text) else ""
