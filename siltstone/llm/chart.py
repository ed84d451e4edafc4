"""A table-driven recogniser for the bundled grammars.

A grammar (EBNF text) becomes a recursive transition network: one deterministic
automaton over terminals and rules for each rule. Text is recognised by all
stacks of network states that its tokens allow, so no grammar needs to be made
free of conflicts. Stacks are shared (each is a state on top of another stack),
and both stacks and sets of stacks are numbered, so the table of moves
``(set, token) -> set`` fills as it is used and is then only looked up; callers
also remember the moves of whole lines. Set 0 is the empty one: an error.
"""

from __future__ import annotations

import re

TOKEN = re.compile(r"\s*(?:'([^']+)'|([A-Za-z_]\w*)|([:|()\[\]*+~;]))")
MOST_STACKS = 400_000


class Grammar:
    """EBNF: ``rule: alternatives ;`` with ( ) [ ] * + and ``~'x'`` before a rule: not if x comes next.

    Names in capitals and quoted text are terminals.
    """

    def __init__(self, text: str, start: str):
        text = re.sub(r"(?m)^\s*#.*$", "", text)
        self._t = [m.group(1) and ("lit", m.group(1)) or m.group(2) and ("name", m.group(2)) or ("op", m.group(3)) for m in TOKEN.finditer(text)]
        self._i = 0
        self.codes: dict[str, int] = {}
        rules: dict[str, tuple] = {}
        while self._i < len(self._t):
            name = self._take("name")
            self._take("op", ":")
            rules[name] = self._alternatives()
            self._take("op", ";")
        self._build(rules, start)

    def _take(self, kind: str, value: str | None = None) -> str:
        k, v = self._t[self._i]
        if k != kind or value not in (None, v):
            raise ValueError(f"grammar: {value or kind} expected at {self._t[max(0, self._i - 4) : self._i + 2]}")
        self._i += 1
        return v

    def _peek(self) -> tuple[str, str]:
        return self._t[self._i]

    def _alternatives(self) -> tuple:
        alts = [self._sequence()]
        while self._peek() == ("op", "|"):
            self._i += 1
            alts.append(self._sequence())
        return ("alt", alts)

    def _sequence(self) -> tuple:
        items, guard = [], []
        while True:
            k, v = self._peek()
            if k == "op" and v in "|;)]":
                return ("seq", items)
            self._i += 1
            if k == "op" and v == "~":
                guard.append(self._term(self._take("lit")))
                continue
            if k == "op" and v in "([":
                x = self._alternatives()
                self._take("op", ")" if v == "(" else "]")
                x = x if v == "(" else ("opt", x)
            elif k == "lit" or v.isupper():
                x = ("term", self._term(v))
            else:
                x = ("rule", v, frozenset(guard))
                guard = []
            k, v = self._peek()
            if k == "op" and v in "*+":
                self._i += 1
                x = ("star" if v == "*" else "plus", x)
            items.append(x)

    def _term(self, v: str) -> int:
        return self.codes.setdefault(v, len(self.codes) + 1)

    def _build(self, rules: dict[str, tuple], start: str) -> None:
        eps: list[list[int]] = []
        arcs: list[list[tuple]] = []

        def new() -> int:
            eps.append([])
            arcs.append([])
            return len(eps) - 1

        def add(x: tuple, a: int) -> int:
            kind = x[0]
            if kind == "seq":
                for y in x[1]:
                    a = add(y, a)
                return a
            if kind == "alt":
                end = new()
                for y in x[1]:
                    eps[add(y, a if len(x[1]) == 1 else self_loop_free(a))].append(end)
                return end
            if kind == "opt":
                b = add(x[1], self_loop_free(a))
                end = new()
                eps[b].append(end)
                eps[a].append(end)
                return end
            if kind in ("star", "plus"):
                s = self_loop_free(a)
                b = add(x[1], s)
                end = new()
                eps[b] += [s, end]
                if kind == "star":
                    eps[a].append(end)
                return end
            b = new()
            arcs[a].append((x, b))
            return b

        def self_loop_free(a: int) -> int:
            b = new()
            eps[a].append(b)
            return b

        def closure(states: frozenset[int]) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for t in eps[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(seen)

        self.terms: list[dict[int, int]] = []  # state -> terminal -> state
        self.calls: list[list[tuple[str, frozenset, int]]] = []
        self.final: list[bool] = []
        self.starts: dict[str, int] = {}
        for name, body in rules.items():
            s = new()
            e = add(body, s)
            numbers: dict[frozenset[int], int] = {}

            def number(c: frozenset[int], e=e, numbers=numbers) -> int:
                if c not in numbers:
                    numbers[c] = len(self.terms)
                    self.terms.append({})
                    self.calls.append([])
                    self.final.append(e in c)
                    me = numbers[c]
                    out: dict[tuple, set[int]] = {}
                    for q in c:
                        for x, b in arcs[q]:
                            out.setdefault(x, set()).add(b)
                    for x, bs in out.items():
                        to = number(closure(frozenset(bs)))
                        if x[0] == "term":
                            self.terms[me][x[1]] = to
                        else:
                            self.calls[me].append((x[1], x[2], to))
                return numbers[c]

            self.starts[name] = number(closure(frozenset([s])))
        self.nullable = {n: False for n in rules}
        self.first: dict[str, set[int]] = {n: set() for n in rules}
        changed = True
        while changed:
            changed = False
            for n in rules:
                f, null, seen, todo = set(), False, set(), [self.starts[n]]
                while todo:
                    q = todo.pop()
                    if q in seen:
                        continue
                    seen.add(q)
                    null = null or self.final[q]
                    f |= set(self.terms[q])
                    for r, guard, to in self.calls[q]:
                        f |= self.first[r] - guard
                        if self.nullable[r]:
                            todo.append(to)
                if f != self.first[n] or null != self.nullable[n]:
                    self.first[n], self.nullable[n], changed = f, null, True
        self.start = self.starts[start]


class Recogniser:
    """Numbered stacks and sets of them; ``move`` is the table."""

    def __init__(self, grammar: Grammar):
        self.g = grammar
        self.codes = grammar.codes
        self.lines: dict = {}  # for callers: moves of whole lines
        self.reset()

    def reset(self) -> None:
        self.top, self.below, self.stacks = [0], [0], {}
        self.sets: dict[frozenset[int], int] = {frozenset(): 0}
        self.members: list[frozenset[int]] = [frozenset()]
        self.moves: dict[int, int] = {}
        self.lines.clear()
        self.begin = self._set(frozenset([self._stack(self.g.start, 0)]))

    def fit(self) -> None:
        """Forget all once the tables are large; only between two texts."""
        if len(self.top) > MOST_STACKS or len(self.lines) > MOST_STACKS or len(self.moves) > MOST_STACKS:
            self.reset()

    def _stack(self, state: int, below: int) -> int:
        k = (state, below)
        i = self.stacks.get(k)
        if i is None:
            i = self.stacks[k] = len(self.top)
            self.top.append(state)
            self.below.append(below)
        return i

    def _set(self, s: frozenset[int]) -> int:
        i = self.sets.get(s)
        if i is None:
            i = self.sets[s] = len(self.members)
            self.members.append(s)
        return i

    def move(self, at: int, token: int) -> int:
        k = at << 9 | token
        to = self.moves.get(k)
        if to is None:
            out: set[int] = set()
            for i in self.members[at]:
                self._step(i, token, out)
            to = self.moves[k] = self._set(frozenset(out))
        return to

    def _step(self, i: int, token: int, out: set[int]) -> None:
        g, todo, seen = self.g, [i], set()
        while todo:
            i = todo.pop()
            if i in seen:
                continue
            seen.add(i)
            state, below = self.top[i], self.below[i]
            to = g.terms[state].get(token)
            if to is not None:
                out.add(self._stack(to, below))
            for rule, guard, to in g.calls[state]:
                if token in g.first[rule] and token not in guard:
                    bare = g.final[to] and not g.terms[to] and not g.calls[to]
                    todo.append(self._stack(g.starts[rule], below if bare and below else self._stack(to, below)))
                if g.nullable[rule]:
                    todo.append(self._stack(to, below))
            if g.final[state] and below:
                todo.append(below)
