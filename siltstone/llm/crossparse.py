"""Problem 8: language by cross-parsing entropy.

A suffix automaton holds a language's labelled text. A sentence is parsed into
the longest phrases that occur in that text; the phrases it needs, times the
logarithm of the text's size, by its length, is its cross-parsing entropy. The
language with the least wins; how far the next one lies behind is the
confidence. Every language is parsed with, whatever the script; two or more to
the end.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import islice, zip_longest

import numpy as np


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of each state: a walk from state 0 spells a substring of the text."""
    nxt: list[dict[str, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for ch in text:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and ch not in nxt[p]:
            nxt[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][ch]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                c = len(nxt)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and nxt[p].get(ch) == q:
                    nxt[p][ch] = c
                    p = link[p]
                link[q] = link[cur] = c
        last = cur
    return nxt


# --- text into sentences

FRONT = re.compile(r"\A﻿?---[ \t]*\r?\n(?:.*\r?\n)*?(?:---|\.\.\.)[ \t]*(?:\r?\n|\Z)")
FENCE = re.compile(r"[ \t]{0,3}(?:>[ \t]*)*(`{3,}|~{3,})")
ITEM = re.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+(?=\S)")
QUOTE = re.compile(r"[ \t]{0,3}(?:>[ \t]?)+")
HEAD = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)|[ \t]*(?:=+|-{3,}|\*{3,}|_{3,})[ \t]*$|[ \t]*<!--.*-->[ \t]*$|[ \t]*\[[^\]]+\]:")
TABLE = re.compile(r"[ \t]*\|")
#: the leading class lets the search skip to a mark; what closes a sentence may follow it
END = re.compile(r"[.!?…。！？](?:(?<=[.!?…])[\"'”’»)*_]*(?:\s+|$)|(?<=[。！？])[」』”）]*\s*)")
NOISE = re.compile(r"`[^`]*`|https?://\S+|\]\([^)\s]*\)|<[^<>\n]{1,80}>|&\w+;")
SPACE = re.compile(r"\s+")
CLOSED = re.compile(r"[.!?…。！？][\"'”’»)*_\]]*\Z")
_CJK = "぀-ヿ㐀-鿿＀-￯\u3000-〿"
CJK_GAP = re.compile(rf" (?<=[{_CJK}] )(?=[{_CJK}])")
LETTERS = re.compile(r"(?:[\W\d_]*[^\W\d_]){4}")


def blocks(text: str) -> Iterator[tuple[str, int, str]]:
    """``(kind, offset, text)`` of prose paragraphs (p) and list items (li); code, front matter, headings and tables don't count."""
    m = FRONT.match(text)
    at = m.end() if m else 0
    kind, start, part, fence = "", 0, [], ""
    for line in text[at:].split("\n"):
        here, at = at, at + len(line) + 1
        line = line.rstrip("\r")
        f = FENCE.match(line)
        if fence:
            if f and f.group(1)[0] == fence[0] and len(f.group(1)) >= len(fence):
                fence = ""
            continue
        body = line
        if not f:
            q = QUOTE.match(line)
            body = line[q.end() :] if q else line
        item = ITEM.match(body)
        if f or not body.strip() or HEAD.match(body) or TABLE.match(body) or item:
            if part:
                yield kind, start, " ".join(part)
            part = []
            if f:
                fence = f.group(1)
            elif item:
                kind, start, part = "li", here, [body[item.end() :].strip()]
            continue
        if not part:
            kind, start = "p", here
        part.append(body.strip())
    if part:
        yield kind, start, " ".join(part)


def clean(s: str) -> str:
    """Lower case, one blank for white space, no inline code, addresses or marks."""
    if "`" in s or "<" in s or "](" in s or "&" in s or "http" in s:
        s = NOISE.sub(" ", s)
    if "**" in s or "__" in s:
        s = s.replace("**", "").replace("__", "")
    s = " ".join(s.split())
    if " " in s and not s.isascii():
        s = CJK_GAP.sub("", s)
    return s.lower()


def _letters(s: str) -> bool:
    return s[:4].isalpha() and len(s) > 3 or LETTERS.match(s) is not None


def sentences(text: str) -> Iterator[tuple[str, int, str]]:
    """``(kind, offset of the block, cleaned sentence)``; whole sentences of paragraphs and list items as wholes."""
    for kind, start, body in blocks(text):
        if kind == "li":
            s = clean(body)
            if _letters(s):
                yield kind, start, s
            continue
        at = 0
        for m in END.finditer(body):
            s = clean(body[at : m.start() + 1])
            at = m.end()
            if _letters(s):
                yield kind, start, s
        if at < len(body) and CLOSED.search(body, at):
            s = clean(body[at:])
            if _letters(s):
                yield kind, start, s


# --- deciding


DIGITS = str.maketrans("123456789", "000000000")


class Languages:
    """The suffix automata of all languages in one table; ``classify`` judges many sentences at once.

    A state's number is the place of its row in a double array: the transition
    of state s by symbol c is cell s + c, which holds s as a check and the next
    state. Rows overlap wherever their cells are free, so the table of ten
    languages has a few megabytes and no row is as wide as the alphabet.
    Sentences are walked in step, one array operation a character for all of
    them and all languages.
    """

    BLOCK = 16  # characters between two looks at which languages are still in the running
    SENTENCES = 4096  # walked at once

    def __init__(self, texts: dict[str, str], seed: int = 1):
        self.names = [k for k, t in sorted(texts.items()) if t]
        texts = {k: texts[k].translate(DIGITS) for k in self.names}
        chars = sorted({ord(c) for k in self.names for c in texts[k]} - set(range(0xFFFF, 0x110000)))
        #: code point -> symbol; 0 for what no language has and what lies beyond the table
        self.symbol = np.zeros(0x10000, dtype=np.int32)
        self.symbol[chars] = np.arange(1, len(chars) + 1)
        self.symbol[0x31:0x3A] = self.symbol[0x30]  # all digits are one
        self.bits = np.array([math.log2(len(texts[k]) + 2) for k in self.names])
        states, symbols, targets, roots, n = [], [], [], [], 0
        for k in self.names:
            nxt = suffix_automaton(texts[k])
            states += [n + i for i, row in enumerate(nxt) for _ in row]
            symbols += [ord(c) for row in nxt for c in row]
            targets += [n + j for row in nxt for j in row.values()]
            roots.append(n)
            n += len(nxt)
        code = np.minimum(np.array(symbols, dtype=np.int64), 0xFFFF)
        sym = self.symbol[code]
        known = sym > 0
        self._place(np.array(states, dtype=np.int64)[known], sym[known].astype(np.int64), np.array(targets, dtype=np.int64)[known], np.array(roots, dtype=np.int64), n, len(chars), seed)

    def _place(self, state: np.ndarray, sym: np.ndarray, target: np.ndarray, roots: np.ndarray, n: int, alphabet: int, seed: int) -> None:
        """Rows into the double array, widest first, each at a random place where all its cells are free."""
        rng = np.random.default_rng(seed)
        room = 2 * len(state) + n // 2 + 64
        free, unused = np.ones(room + alphabet + 1, dtype=bool), np.ones(room, dtype=bool)
        base = np.full(n, -1, dtype=np.int64)
        degree = np.bincount(state, minlength=n)
        start = np.concatenate(([0], np.cumsum(degree)))  # edges are in the order of their states
        for lo, hi in ((64, 1 << 30), (16, 64), (8, 16), (4, 8), (3, 4), (2, 3), (1, 2), (0, 1)):
            todo = np.flatnonzero((degree >= lo) & (degree < hi))
            while len(todo):
                # few at a time while rows are wide, so that they don't stand in each other's way
                now = todo[: 8 if lo == 64 else len(todo)]
                b = rng.integers(1, room, len(now))
                d = degree[now]
                row = np.repeat(np.arange(len(now)), d)
                edge = np.repeat(start[now] - np.concatenate(([0], np.cumsum(d)[:-1])), d) + np.arange(d.sum())
                cell = b[row] + sym[edge]
                first = np.zeros(len(cell), dtype=bool)
                first[np.unique(cell, return_index=True)[1]] = True
                ok = unused[b]
                own = np.zeros(len(now), dtype=bool)
                own[np.unique(b, return_index=True)[1]] = True
                ok &= own
                np.logical_and.at(ok, row, first & free[cell])
                base[now[ok]] = b[ok]
                unused[b[ok]] = False
                free[cell[ok[row]]] = False
                todo = todo[base[todo] < 0]
        table = np.full(room + alphabet + 1, -1, dtype=np.int64)
        table[base[state] + sym] = (base[state] << 32) | base[target]
        self.table = table
        self.root = base[roots].astype(np.int32)
        #: where a new phrase begins: by language and symbol; the root itself where the language lacks the symbol
        cells = table[self.root[:, None].astype(np.int64) + np.arange(alphabet + 1)]
        self.begin = np.where(cells >> 32 == self.root[:, None], cells & 0xFFFFFFFF, self.root[:, None]).astype(np.int32).ravel() if len(self.names) else np.zeros(0, np.int32)
        self.width = alphabet + 1

    def entropies(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each sentence's cross-parse by language (infinite where given up), and the symbols the language lacks.

        A language is given up as soon as two others lie clearly ahead on what
        has been read so far, so each sentence is parsed to its end by two
        languages or more.
        """
        n, k = len(sentences), len(self.names)
        bits, lacking = np.full((n, k), np.inf), np.zeros((n, k))
        order = sorted(range(n), key=lambda i: len(sentences[i]))
        for at in range(0, n, self.SENTENCES):
            some = order[at : at + self.SENTENCES]
            self._walk([sentences[i] for i in some], np.array(some), bits, lacking)
        return bits, lacking

    def _walk(self, sents: list[str], where: np.ndarray, bits: np.ndarray, lacking: np.ndarray) -> None:
        k, step, table = len(self.names), self.BLOCK, self.table
        size = np.array([len(s) for s in sents])
        symbols = self.symbol[np.minimum(np.frombuffer("".join(sents).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF)]
        symbols = np.append(symbols, np.zeros(step, dtype=np.int32))
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        who = np.repeat(np.arange(len(sents)), k)  # sentence and language of each parse
        lang = np.tile(np.arange(k), len(sents))
        s, count, lack = self.root[lang], np.ones(len(who), dtype=np.int32), np.zeros(len(who), dtype=np.int32)
        t = 0
        while len(who):
            alive, mine = np.unique(who, return_inverse=True)
            places = begin[alive][:, None] + np.arange(t, t + step)
            inside = np.arange(t, t + step) < size[alive][:, None]
            window = np.where(inside, symbols[np.minimum(places, len(symbols) - 1)], 0).T.copy()
            row = lang.astype(np.int32) * self.width
            for c in window:
                sym = c[mine]
                cell = table[s + sym]
                miss = np.flatnonzero((cell >> 32) != s)
                s = cell.astype(np.int32)  # the lower half
                count[miss] += 1
                r = self.begin[row[miss] + sym[miss]]
                s[miss] = r
                lack[miss] += r == self.root[lang[miss]]
            t += step
            over = t - size[who]  # what lies beyond the end has been counted as phrases of one symbol
            done = over >= 0
            if done.any():
                w, x = where[who[done]], lang[done]
                bits[w, x] = (count[done] - over[done]) * self.bits[x]
                lacking[w, x] = lack[done] - over[done]
            keep = ~done
            if t >= 2 * step and keep.any():
                score = count * self.bits[lang]
                edge = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
                group = np.cumsum(np.concatenate(([True], who[1:] != who[:-1]))) - 1
                best = np.minimum.reduceat(score, edge)
                lead = score == best[group]
                rest = np.where(lead, np.inf, score)
                second = np.where(np.add.reduceat(lead, edge) > 1, best, np.minimum.reduceat(rest, edge))
                keep &= score <= np.maximum(second, 1.3 * best + 2 * self.bits.max())[group]
            who, lang, s, count, lack = who[keep], lang[keep], s[keep], count[keep], lack[keep]

    def classify(self, sentences: list[str]) -> list[tuple[str | None, float]]:
        """``(language, confidence)`` of each cleaned sentence; ``(None, 0)`` where no language explains it.

        That is where the best language lacks more than half of the characters
        (another script), or where many short phrases are needed and the next
        language does as well.
        """
        if not sentences or not self.names:
            return [(None, 0.0)] * len(sentences)
        bits, lacking = self.entropies(sentences)
        size = np.array([len(s) for s in sentences])
        at = np.arange(len(sentences))
        lang = bits.argmin(axis=1)
        best = bits[at, lang]
        second = np.partition(bits, 1, axis=1)[:, 1] if len(self.names) > 1 else np.full(len(at), np.inf)
        unread = 2 * lacking[at, lang] > size
        vague = (best / (size + 1) > 5.5) & (second < 1.1 * best)
        with np.errstate(invalid="ignore"):
            conf = np.where(np.isinf(second), 0.99, np.minimum(0.99, 1 - best / (best + second))).round(4)
        return [(None, 0.0) if no else (self.names[x], c) for x, c, no in zip(lang.tolist(), conf.tolist(), (unread | vague).tolist())]


def segments(heard: list[tuple[str, int, str | None, float]]) -> list[tuple[int, str, int, int, float]]:
    """``(offset, language, sentences, list items, confidence)`` of each run in one language, in order."""
    out: list[list] = []
    for kind, start, lang, conf in heard:
        if lang is None:
            continue
        if out and out[-1][1] == lang:
            out[-1][2] += kind == "p"
            out[-1][3] += kind == "li"
            out[-1][4] += conf
        else:
            out.append([start, lang, int(kind == "p"), int(kind == "li"), conf])
    return [(a, x, p, li, round(c / (p + li), 4)) for a, x, p, li, c in out]


def present(heard: list[tuple[str, int, str | None, float]]) -> dict[str, float]:
    """Languages of a document: two whole sentences in a row, or two list items; with the mean confidence."""
    got: dict[str, list[float]] = {}
    run_lang, run = None, []
    items: dict[str, list[float]] = {}
    for kind, _, lang, conf in heard:
        if lang is None:
            continue
        if kind == "li":
            items.setdefault(lang, []).append(conf)
            continue
        if lang != run_lang:
            run_lang, run = lang, []
        run.append(conf)
        if len(run) >= 2:
            got.setdefault(lang, []).append(conf)
    for lang, c in items.items():
        if len(c) >= 2:
            got.setdefault(lang, []).extend(c)
    return {k: round(sum(v) / len(v), 4) for k, v in got.items()}


def hear(model: Languages, texts: list[str | None]) -> list[list[tuple[str, int, str | None, float]]]:
    """For each text its sentences in order: ``(kind, offset, language, confidence)``. Equal sentences are judged once."""
    split = [list(sentences(t)) if t else [] for t in texts]
    own = list(dict.fromkeys(s for x in split for _, _, s in x))
    judged = dict(zip(own, model.classify(own)))
    return [[(kind, start, *judged[s]) for kind, start, s in x] for x in split]


def train(rows: Iterable[tuple[str, str]], most_chars: int, most_sentences: int = 40, rounds: int = 2) -> dict[str, str]:
    """Labelled texts -> text per language, from the first ``most_sentences`` different sentences of each.

    Labels are partly wrong, so each half of the texts is judged by automata of
    the other half: a text stays if four fifths of its sentences get its label,
    with those that do. Each round judges by what the one before kept. All
    texts of a label give sentences in turn, so that a long text with a wrong
    label has no more weight than any other.
    """
    halves: list[list[tuple[str, list[str]]]] = [[], []]
    seen: dict[str, int] = {}
    for lang, text in rows:
        own = list(dict.fromkeys(s for _, _, s in islice(sentences(text), 2 * most_sentences)))[:most_sentences]
        if own:
            seen[lang] = seen.get(lang, 0) + 1
            halves[seen[lang] % 2].append((lang, own))

    def joined(docs: list[tuple[str, list[str]]], most: int) -> dict[str, str]:
        by_lang: dict[str, list[list[str]]] = {}
        for lang, ss in docs:
            by_lang.setdefault(lang, []).append(ss)
        out = {}
        for lang, texts in by_lang.items():
            parts: dict[str, None] = {}
            size = 0
            for turn in zip_longest(*texts):
                for s in turn:
                    if s is not None and size <= most and s not in parts:
                        parts[s] = None
                        size += len(s) + 1
            out[lang] = "\n".join(parts)
        return out

    kept = halves
    for r in range(rounds):
        models = [Languages(joined(kept[k], most_chars if r else most_chars // 2)) for k in (0, 1)]
        nxt: list[list[tuple[str, list[str]]]] = [[], []]
        for k in (0, 1):
            own = list(dict.fromkeys(s for _, ss in halves[k] for s in ss))
            judged = dict(zip(own, (x for x, _ in models[1 - k].classify(own))))
            for lang, ss in halves[k]:
                good = [s for s in ss if judged[s] == lang]
                if len(good) >= 0.8 * len(ss):
                    nxt[k].append((lang, good))
        kept = nxt
    return joined(kept[0] + kept[1], most_chars)
