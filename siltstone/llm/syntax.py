"""Problem 1: the first unrecoverable syntax error of a file, by the recogniser in ``chart``.

``first_error(language, text)`` scans the whole token stream with the language's
bundled grammar and returns ``None`` or ``(line, reason)``.
"""

from __future__ import annotations

import re
from functools import cache
from importlib.resources import files

from siltstone.llm.chart import Grammar, Recogniser

LANGUAGES = ("python", "javascript", "bash", "json", "yaml", "toml")


@cache
def recogniser(language: str) -> Recogniser:
    return Recogniser(Grammar(files("siltstone.llm").joinpath("grammars", f"{language}.ebnf").read_text(), "file"))


def first_error(language: str, text: str) -> tuple[int, str] | None:
    """Line (from 1) and reason of the first error; ``None`` if the text is valid. Null text counts as empty."""
    text = (text or "").removeprefix("\ufeff")
    if "\0" in text:
        return text.count("\n", 0, text.index("\0")) + 1, "NUL character"
    r = recogniser(language)
    r.fit()
    return globals()[f"_{language}"](r, text)


# --- JSON

_JSON = re.compile(r'[ \t\n\r]+|"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[{}\[\],:]|(?:true|false|null)\b|[\s\S]')


def _json(r: Recogniser, text: str) -> tuple[int, str] | None:
    c, at, move, n = r.codes, r.begin, r.moves, 0
    kinds = {'"': c["STRING"], "t": c["true"], "f": c["false"], "n": c["null"]} | {x: c[x] for x in "{}[],:"} | {x: c["NUMBER"] for x in "-0123456789"}
    for t in _JSON.findall(text):
        f = t[0]
        if f in " \t\n\r":
            n += len(t)
            continue
        k = kinds.get(f, 0)
        if k == 0 or (len(t) == 1 and f in '"-tfn'):
            return text.count("\n", 0, n) + 1, "unreadable token"
        to = move.get(at << 9 | k)
        at = r.move(at, k) if to is None else to
        if not at:
            return text.count("\n", 0, n) + 1, f"unexpected {t[:20]}"
        n += len(t)
    if not r.move(at, c["EOF"]):
        return text.count("\n") + 1, "unexpected end"
    return None


# --- TOML

_TOML = re.compile(
    r'[ \t]+|#[^\n]*|\r?\n|"""(?:[^"\\]|\\[\s\S]|"(?!""))*"{3,5}|\'\'\'(?:[^\']|\'(?!\'\'))*\'{3,5}|"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\'|\[\[|\]\]|[\[\]{}=,.]|[A-Za-z0-9_+:-]+|[\s\S]'
)
_TOML_SCALAR = re.compile(
    r"(?:true|false|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    r"|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?)\Z"
)


_TOML_DATE = re.compile(r"(?:(\d{4})-(\d\d)-(\d\d))?[Tt ]?(?:(\d\d):(\d\d):(\d\d)(?:\.\d+)?(?:[Zz]|[+-](\d\d):(\d\d))?)?\Z")
_TOML_ESCAPE = re.compile(r'\\(?![btnfr"\\]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|U000(?!0[dD][89a-fA-F])[0-9a-fA-F]{5}|U0010[0-9a-fA-F]{4})')
_TOML_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\r(?!\n)")


def _toml_scalar(t: str) -> bool:
    if not _TOML_SCALAR.match(t):
        return False
    m = _TOML_DATE.match(t)
    if not m:
        return True
    year, month, day, h, mi, se, oh, om = (None if x is None else int(x) for x in m.groups())
    if year is not None:
        most = 30 + (month + month // 8) % 2 if month != 2 else 28 + (year % 4 == 0 and (year % 100 != 0 or year % 400 == 0))
        if not (1 <= year and 1 <= month <= 12 and 1 <= day <= most):
            return False
    return (h is None or h < 24 and mi < 60 and se < 60) and (oh is None or oh < 24 and om < 60)


class _TomlTable:
    """What a table may still get: ``how`` is root, header, implied (by a longer header), dotted or element."""

    def __init__(self, how: str):
        self.how, self.items = how, {}

    def open(self, key: list[str], array: bool) -> "_TomlTable | None":
        """The table that a header names, from the root; ``None`` if it can't be named (again)."""
        at = self
        for k in key[:-1]:
            x = at.items.setdefault(k, _TomlTable("implied"))
            at = x[-1] if isinstance(x, list) else x
            if not isinstance(at, _TomlTable):
                return None
        x = at.items.get(key[-1])
        if array:
            if x is None:
                x = at.items[key[-1]] = []
            if not isinstance(x, list):
                return None
            x.append(_TomlTable("element"))
            return x[-1]
        if x is None:
            x = at.items[key[-1]] = _TomlTable("header")
        elif isinstance(x, _TomlTable) and x.how == "implied":
            x.how = "header"
        else:
            return None
        return x

    def put(self, key: list[str]) -> bool:
        """Whether a value may be put under a (dotted) key of this table."""
        at = self
        for k in key[:-1]:
            at = at.items.setdefault(k, _TomlTable("dotted"))
            if not isinstance(at, _TomlTable) or at.how != "dotted":
                return False
        if key[-1] in at.items:
            return False
        at.items[key[-1]] = "value"
        return True


def _toml(r: Recogniser, text: str) -> tuple[int, str] | None:
    c, at, line, deep, value = r.codes, r.begin, 1, [], False
    toks = _TOML.findall(text)
    i = 0
    root = table = _TomlTable("root")
    key, header, outer = [], "", []  # outer: key and table around each inline table
    while i < len(toks):
        t = toks[i]
        i += 1
        f = t[0]
        if f in " \t" or f == "#":
            if _TOML_CONTROL.search(t):
                return line, "control character"
            continue
        if f in "\r\n" and t[-1] == "\n":
            k = c["NL"] if not deep or deep[-1] == "[" else 0
            line += 1
            if not deep:
                value, key, header = False, [], ""
            if k == 0:
                return line, "line break in an inline table"
        elif f in "\"'":
            many = t[:3] in ('"""', "'''") and len(t) > 5
            k = c["MLSTRING"] if many else c["STRING"]
            if len(t) < 2 or t[-1] != f:
                return line, "unterminated string"
            if _TOML_CONTROL.search(t) or f == '"' and _TOML_ESCAPE.search(re.sub(r"\\\\|\\[ \t]*\r?\n", "", t) if many else t.replace("\\\\", "")):
                return line, "unreadable string"
            line += t.count("\n")
            if not value and not (deep and deep[-1] == "["):
                key.append(t[1:-1].encode("latin-1", "backslashreplace").decode("unicode-escape") if f == '"' and "\\" in t else t[1:-1])
        elif t in ("[[", "]]") and (value or deep):
            # in values these are two brackets
            toks[i - 1 : i] = [f, f]
            i -= 1
            continue
        elif f == "[":
            k = c[t]
            if value or deep:
                deep.append("[")
            else:
                header = t
        elif f == "]":
            k = c[t]
            if deep:
                deep.pop()
            elif header and key:
                table = root.open(key, header == "[[")
                if table is None:
                    return line, "repeated table"
                header = ""
        elif f == "{":
            k = c["{"]
            deep.append("{")
            outer.append((key, table))
            key, table, value = [], _TomlTable("root"), False
        elif f == "}":
            k = c["}"]
            if deep:
                deep.pop()
            if outer:
                key, table = outer.pop()
            value = True
        elif f == "=":
            k = c["="]
            if key and not table.put(key):
                return line, "repeated key"
            value = True
        elif f == ",":
            k = c[","]
            if deep and deep[-1] == "{":
                value, key = False, []
        elif f == "." and not value:
            k = c["."]
        elif re.match(r"[A-Za-z0-9_+:-]", f):
            if value or (deep and deep[-1] == "["):
                while i < len(toks) and (toks[i] == "." or (toks[i - 1] == "." and re.match(r"[\w+-]", toks[i]))):
                    t += toks[i]
                    i += 1
                if re.match(r"\d{4}-\d\d-\d\d\Z", t) and i + 1 < len(toks) and toks[i] == " " and re.match(r"\d\d:", toks[i + 1]):
                    t += " " + toks[i + 1]
                    i += 2
                    while i < len(toks) and (toks[i] == "." or (toks[i - 1] == "." and re.match(r"[\w+-]", toks[i]))):
                        t += toks[i]
                        i += 1
                if not _toml_scalar(t):
                    return line, f"unreadable value {t[:20]}"
                k = c["SCALAR"]
            else:
                if not re.match(r"[A-Za-z0-9_-]+\Z", t):
                    return line, "unreadable key"
                k = c["BARE"]
                key.append(t)
        else:
            return line, f"unexpected {t[:20]}"
        at = r.move(at, k)
        if not at:
            return line, f"unexpected {t[:20]!r}"
    if not r.move(at, c["EOF"]):
        return line, "unexpected end"
    return None


# --- YAML

_Y_PLAIN_B = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=\S))(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s#]))*")
_Y_PLAIN_F = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=[^\s,\[\]{}]))(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?=[^\s#,\[\]{}]))*")
_Y_DQ = re.compile(r'"(?:[^"\\]|\\[\s\S])*"')
_Y_SQ = re.compile(r"'(?:[^']|'')*'")
_Y_PROP = re.compile(r"(?:[&!][^\s,\[\]{}]*[ \t]*)+")
_Y_BLOCK = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:[ \t]#[^\n]*)?\r?(?:\n|\Z)")


def _yaml(r: Recogniser, text: str) -> tuple[int, str] | None:
    """Scans as the YAML reference loaders do: indentation opens and closes MAP and SEQ."""
    c = r.codes
    at, i, n, line = r.begin, 0, len(text), 1
    bol, indents, flow, started = 0, [-1], 0, False  # bol: offset of the line's first character
    pending: tuple | None = None  # set of states before a node that may turn out to be a key
    key_ok = True
    names = {v: k for k, v in c.items()}

    class Stop(Exception):
        pass

    def go(name: str) -> None:
        nonlocal at
        at = r.move(at, c[name])
        if not at:
            raise Stop(f"unexpected {name}")

    def unwind(col: int) -> None:
        while indents[-1] > col:
            indents.pop()
            go("END")

    def node(name: str, start: int, simple: bool) -> None:
        """A node token; if ':' follows on its line it is a key, and MAP and KEY come first."""
        nonlocal i, at, key_ok
        col = start - bol0
        m = _y_colon(text, i, flow)
        if not flow and m and simple:
            if not key_ok:
                raise Stop("a mapping isn't allowed here")
            if indents[-1] < col:
                indents.append(col)
                go("MAP")
            go("KEY")
        go(name)
        key_ok = False
        if m and not flow and not simple:
            raise Stop("a key of several lines")

    try:
        while True:
            # white space, comments and line breaks
            nl = False
            while i < n:
                ch = text[i]
                if ch == " " or (ch == "\t" and (flow or i > bol and text[bol:i].strip(" "))) or ch == "\r":
                    i += 1
                elif ch == "\n":
                    i += 1
                    line += 1
                    bol, nl = i, True
                elif ch == "#" and (i == bol or text[i - 1] in " \t\n"):
                    j = text.find("\n", i)
                    i = n if j < 0 else j
                else:
                    break
            if nl and not flow:
                key_ok = True
            if i >= n:
                break
            ch, col, bol0, line0 = text[i], i - bol, bol, line
            if ch == "\t":
                raise Stop("tab as indentation")
            if not flow:
                if col == 0 and text[i : i + 3] in ("---", "...") and (i + 3 >= n or text[i + 3] in " \t\r\n"):
                    unwind(-1)
                    go(text[i : i + 3])
                    i += 3
                    key_ok = False
                    started = True
                    if text[i - 3 : i] == "---":
                        bol0 = bol
                    continue
                if col == 0 and ch == "%" and not started:
                    j = text.find("\n", i)
                    i = n if j < 0 else j
                    at = r.move(at, c["DIRECTIVES"]) or at
                    continue
                unwind(col)
                started = True
                nxt = text[i + 1] if i + 1 < n else "\n"
                if ch == "-" and nxt in " \t\r\n":
                    if not key_ok:
                        raise Stop("a list isn't allowed here")
                    if indents[-1] < col:
                        indents.append(col)
                        go("SEQ")
                    go("-")
                    i += 1
                    key_ok = True
                    continue
                if ch == "?" and nxt in " \t\r\n":
                    if indents[-1] < col:
                        indents.append(col)
                        go("MAP")
                    go("KEY")
                    i += 1
                    key_ok = True
                    continue
                if ch == ":" and nxt in " \t\r\n":
                    if pending is None and indents[-1] < col and key_ok:
                        indents.append(col)
                        go("MAP")
                    go(":")
                    i += 1
                    key_ok = pending is None
                    pending = None
                    continue
                if ch in "|>":
                    m = _Y_BLOCK.match(text, i)
                    if not m:
                        raise Stop("bad block scalar header")
                    go("SCALAR")
                    i = m.end()
                    line += 1
                    bol = i
                    parent = max(indents[-1], 0 if indents[-1] < 0 else indents[-1])
                    least = indents[-1] + 1
                    while i < n:
                        j = text.find("\n", i)
                        j = n if j < 0 else j
                        s = text[i:j]
                        lead = len(s) - len(s.lstrip(" "))
                        if s.strip() and lead < max(least, 0 if parent < 0 else least):
                            break
                        if s.strip() and least == 0 and s[:3] in ("---", "..."):
                            break
                        i = min(n, j + 1)
                        if j < n:
                            line += 1
                        bol = i
                    key_ok = True
                    continue
            elif ch in ",?" or (ch == ":" and _y_colon(text, i, flow)):
                if ch == "?" and not (i + 1 < n and text[i + 1] in " \t\r\n"):
                    pass
                else:
                    go(ch)
                    i += 1
                    continue
            if ch in "[{":
                start, begun = i, line
                if not flow and _y_flow_is_key(text, i):
                    if not key_ok:
                        raise Stop("a mapping isn't allowed here")
                    if indents[-1] < col:
                        indents.append(col)
                        go("MAP")
                    go("KEY")
                    pending = (True,)
                flow += 1
                go(ch)
                i += 1
                continue
            if ch in "]}":
                if not flow:
                    raise Stop(f"unexpected {ch}")
                flow -= 1
                go(ch)
                i += 1
                key_ok = False
                continue
            if flow and indents[-1] >= col and nl and indents[-1] >= 0 and ch not in "]}":
                pass
            start = i
            m = _Y_PROP.match(text, i)
            if m:
                rest = text[m.end() :].split("\n", 1)[0].rstrip("\r")
                i = m.end()
                if not flow and rest and not rest.startswith("#"):
                    k = _y_key_after(text, i)
                    if k and indents[-1] < col and key_ok:
                        indents.append(col)
                        go("MAP")
                    if k:
                        go("KEY")
                        go("PROPS")
                        key_ok = True
                        m2 = k
                        go("SCALAR")
                        i = m2
                        pending = (True,)
                        key_ok = False
                        continue
                go("PROPS")
                continue
            if ch == "*":
                m = re.compile(r"\*[^\s,\[\]{}]+").match(text, i)
                if not m:
                    raise Stop("bad alias")
                i = m.end()
                node("ALIAS", start, True)
                pending = (True,) if _y_colon(text, i, flow) else None
                continue
            if ch in "\"'":
                m = (_Y_DQ if ch == '"' else _Y_SQ).match(text, i)
                if not m:
                    raise Stop("unterminated quoted scalar")
                i = m.end()
                s = m.group()
                node("SCALAR", start, "\n" not in s)
                if "\n" in s:
                    line += s.count("\n")
                    bol = start + s.rindex("\n") + 1
                    if not flow and any(x.strip() and len(x) - len(x.lstrip(" ")) <= indents[-1] for x in s.split("\n")[1:]):
                        raise Stop("quoted scalar not indented")
                pending = (True,) if _y_colon(text, i, flow) else None
                continue
            if flow:
                m = _Y_PLAIN_F.match(text, i)
                if not m:
                    raise Stop(f"unexpected {ch!r}")
                i = m.end()
                while True:  # further lines of a plain scalar
                    j = re.compile(r"[ \t\r]*(?:\n[ \t\r]*)+").match(text, i)
                    if not j or j.end() >= n or text[j.end()] in "#,[]{}:'\"":
                        break
                    m2 = re.compile(r"(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?=[^\s#,\[\]{}]))+").match(text, j.end())
                    if not m2:
                        break
                    line += j.group().count("\n")
                    bol = i + j.group().rindex("\n") + 1
                    i = m2.end()
                go("SCALAR")
                continue
            m = _Y_PLAIN_B.match(text, i)
            if not m:
                raise Stop(f"unexpected {ch!r}")
            i = m.end()
            simple = True
            if not _y_colon(text, i, 0):
                while True:
                    if re.compile(r"[ \t]+#").match(text, i):
                        break
                    j = re.compile(r"[ \t\r]*\n(?:[ \t]*\r?\n)*").match(text, i)
                    if not j:
                        break
                    k = j.end()
                    lead = re.compile(" *").match(text, k).end() - k
                    if k + lead >= n or lead <= indents[-1] or text[k + lead] == "#":
                        break
                    if lead == 0 and text[k : k + 3] in ("---", "..."):
                        break
                    m2 = re.compile(r"(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s#]))+").match(text, re.compile(r"[ \t]*").match(text, k).end())
                    if not m2:
                        break
                    line += j.group().count("\n")
                    bol, i, simple = k, m2.end(), False
                    if _y_colon(text, i, 0):
                        break
            node("SCALAR", start, simple)
            pending = (True,) if _y_colon(text, i, 0) else None
            if not simple:
                key_ok = False
        if flow:
            raise Stop("unclosed bracket")
        unwind(-1)
        go("EOF")
    except Stop as e:
        return line, str(e)
    return None


def _y_colon(text: str, i: int, flow: int) -> bool:
    n = len(text)
    while i < n and text[i] in " \t":
        i += 1
    return i < n and text[i] == ":" and (i + 1 >= n or text[i + 1] in " \t\r\n" or bool(flow) and (text[i + 1] in ",[]{}" or text[i - 1] in "\"'"))


def _y_key_after(text: str, i: int) -> int:
    """End of the scalar at i if it is a key, else 0."""
    ch = text[i]
    m = _Y_DQ.match(text, i) if ch == '"' else _Y_SQ.match(text, i) if ch == "'" else _Y_PLAIN_B.match(text, i)
    return m.end() if m and "\n" not in m.group() and _y_colon(text, m.end(), 0) else 0


def _y_flow_is_key(text: str, i: int) -> bool:
    """Whether the bracket at i closes on its line with a ':' behind it."""
    depth, j = 0, i
    while j < len(text) and text[j] != "\n":
        ch = text[j]
        if ch in "\"'":
            m = (_Y_DQ if ch == '"' else _Y_SQ).match(text, j)
            if m:
                j = m.end()
                continue
        depth += (ch in "[{") - (ch in "]}")
        j += 1
        if not depth:
            return _y_colon(text, j, 0)
    return False


# --- Bash

_SH_RESERVED = {"if", "then", "else", "elif", "fi", "do", "done", "case", "esac", "while", "until", "for", "select", "function", "in", "{", "}", "!", "[[", "]]", "time", "coproc"}
_SH_OP = re.compile(r";;&|;;|;&|&&|\|\||\|&|[;&|()]")
_SH_REDIR = re.compile(r"(?:\d+|\{\w+\})?(?:<<<|<<-?|<>|<&|>>|>&|>\||&>>|&>|<(?!\()|>(?!\())")
_SH_TEXT = re.compile(r"[^\s;&|()<>\"'`$\\#]+|#")
_SH_ASSIGN = re.compile(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=")
_SH_VAR = re.compile(r"\$(?:\w+|[@*#?$!_-])?")


class _Bad(Exception):
    pass


def _sh_dq(s: str, i: int) -> int:
    """End of the double-quoted text whose quote is at i."""
    n, i = len(s), i + 1
    while i < n:
        ch = s[i]
        if ch == '"':
            return i + 1
        if ch == "\\":
            i += 2
        elif ch == "$":
            i = _sh_dollar(s, i, True)
        elif ch == "`":
            i = _sh_tick(s, i)
        else:
            i += 1
    raise _Bad("unterminated quote")


def _sh_tick(s: str, i: int) -> int:
    j = i + 1
    while j < len(s) and s[j] != "`":
        j += 2 if s[j] == "\\" else 1
    if j >= len(s):
        raise _Bad("unterminated backquote")
    return j + 1


def _sh_close(s: str, i: int, a: str, b: str) -> int:
    """Behind the bracket b that closes the a before i; quotes are skipped."""
    depth, n = 1, len(s)
    while i < n:
        ch = s[i]
        if ch == "\\":
            i += 2
            continue
        if ch == "'":
            j = s.find("'", i + 1)
            if j < 0:
                raise _Bad("unterminated quote")
            i = j + 1
            continue
        if ch == '"':
            i = _sh_dq(s, i)
            continue
        if ch == "`":
            i = _sh_tick(s, i)
            continue
        if ch == "$" and s[i + 1 : i + 2] in ("{", "("):
            i = _sh_dollar(s, i, False)
            continue
        if ch == "#" and b == ")" and s[i - 1] in " \t\n;(":
            j = s.find("\n", i)
            i = n if j < 0 else j
            continue
        depth += (ch == a) - (ch == b)
        i += 1
        if not depth:
            return i
    raise _Bad(f"unterminated {a}")


def _sh_brace(s: str, i: int, quoted: bool) -> int:
    n = len(s)
    while i < n:
        ch = s[i]
        if ch == "}":
            return i + 1
        if ch == "\\":
            i += 2
        elif ch == "'" and not quoted:
            j = s.find("'", i + 1)
            if j < 0:
                raise _Bad("unterminated quote")
            i = j + 1
        elif ch == '"':
            i = _sh_dq(s, i)
        elif ch == "$":
            i = _sh_dollar(s, i, quoted)
        elif ch == "`":
            i = _sh_tick(s, i)
        else:
            i += 1
    raise _Bad("unterminated ${")


def _sh_dollar(s: str, i: int, quoted: bool) -> int:
    nxt = s[i + 1 : i + 2]
    if nxt == "{":
        return _sh_brace(s, i + 2, quoted)
    if s.startswith("$((", i):
        j = _sh_close(s, i + 2, "(", ")")
        if s[j - 2 : j] == "))":
            return j
    if nxt == "(":
        j = _sh_close(s, i + 2, "(", ")")
        e = _bash(recogniser("bash"), s[i + 2 : j - 1])
        if e:
            raise _Bad(f"in a substitution: {e[1]}")
        return j
    if nxt == "'" and not quoted:
        j = i + 2
        while j < len(s) and s[j] != "'":
            j += 2 if s[j] == "\\" else 1
        if j >= len(s):
            raise _Bad("unterminated quote")
        return j + 1
    if nxt == '"' and not quoted:
        return _sh_dq(s, i + 1)
    return _SH_VAR.match(s, i).end()


def _sh_semicolons(s: str, i: int, n: int) -> int:
    """Semicolons of s[i:n] outside quotes and expansions."""
    k = 0
    while i < n:
        ch = s[i]
        if ch == "\\":
            i += 2
        elif ch == "'":
            i = s.find("'", i + 1) + 1 or n
        elif ch == '"':
            i = _sh_dq(s, i)
        elif ch == "`":
            i = _sh_tick(s, i)
        elif ch == "$":
            i = _sh_dollar(s, i, False)
        else:
            k, i = k + (ch == ";"), i + 1
    return k


def _bash(r: Recogniser, s: str) -> tuple[int, str] | None:
    c, at, i, n, here, start_of_command = r.codes, r.begin, 0, len(s), [], True
    tests, last = 0, ""
    try:
        while i < n:
            ch = s[i]
            if ch in " \t" or (ch == "\\" and s[i + 1 : i + 2] == "\n"):
                i += 1 + (ch == "\\")
                continue
            if ch == "\r" and s[i + 1 : i + 2] == "\n":
                i += 1
                continue
            if ch == "#":
                j = s.find("\n", i)
                i = n if j < 0 else j
                continue
            if ch == "\n":
                k, i = "NL", i + 1
                for word, strip in here:
                    while i < n:
                        j = s.find("\n", i)
                        j = n if j < 0 else j
                        body = s[i:j].rstrip("\r")
                        i = min(n, j + 1)
                        if (body.lstrip("\t") if strip else body) == word:
                            break
                here = []
            elif (m := _SH_REDIR.match(s, i)) and not (tests and m.group() in "<>"):
                i, k = m.end(), "REDIR"
                if m.group().lstrip("0123456789") in ("<<", "<<-"):
                    m2 = re.compile(r"[ \t]*((?:\\.|'[^']*'|\"[^\"]*\"|[^\s;&|()<>'\"\\])+)").match(s, i)
                    if not m2:
                        raise _Bad("here-document without a word")
                    here.append((re.sub(r"['\"\\]", "", m2.group(1)), m.group().endswith("-")))
                    i, k = m2.end(), "HEREDOC"
            elif s.startswith("((", i) and (start_of_command or last == "for"):
                j = _sh_close(s, i + 1, "(", ")")
                if last == "for" or s[j - 2 : j] == "))":  # Bash takes text between the two brackets behind for
                    if last == "for" and _sh_semicolons(s, i + 2, j - 1) != 2:
                        raise _Bad("for without three expressions")
                    i, k = j, "ARITH"
                else:
                    i, k = i + 1, "("
            elif m := _SH_OP.match(s, i):
                i, k = m.end(), m.group()
            else:
                b, bare = i, True
                while i < n:
                    ch = s[i]
                    if m := _SH_TEXT.match(s, i):
                        i = m.end()
                    elif ch == "\\":
                        i, bare = i + 2, False
                    elif ch == "'":
                        j = s.find("'", i + 1)
                        if j < 0:
                            raise _Bad("unterminated quote")
                        i, bare = j + 1, False
                    elif ch == '"':
                        i, bare = _sh_dq(s, i), False
                    elif ch == "`":
                        i, bare = _sh_tick(s, i), False
                    elif ch == "$":
                        i, bare = _sh_dollar(s, i, False), False
                    elif ch in "<>" and s[i + 1 : i + 2] == "(":
                        i, bare = _sh_close(s, i + 2, "(", ")"), False
                    elif ch == "(" and i > b and s[i - 1] in "?*+@!" and not start_of_command:
                        i = _sh_close(s, i + 1, "(", ")")
                    elif ch == "(" and tests:
                        i = _sh_close(s, i + 1, "(", ")")
                    elif ch in "<>" and tests and i == b:
                        i += 1
                    else:
                        break
                if i == b:
                    i += 1
                w = s[b:i]
                if tests and "=~" == w:
                    m = re.compile(r"[ \t]+(?:\\.|'[^']*'|\"[^\"]*\"|\[[^\]]*\]+|\([^)]*\)|[^\s\\])+").match(s, i)
                    i = m.end() if m else i
                k = "WORD"
                if bare and w in _SH_RESERVED:
                    k = w
                    tests += (w == "[[" and start_of_command) - (w == "]]" and tests > 0)
                elif _SH_ASSIGN.match(w):
                    k = "ASSIGN"
                    if i < n and s[i] == "(" and _SH_ASSIGN.fullmatch(w):
                        i, k = i + 1, "ARRAY"
            at = r.move(at, c[k])
            if not at:
                raise _Bad(f"unexpected {k}")
            last = k
            start_of_command = k in (";", "&", "&&", "||", "|", "|&", "NL", "(", "{", "then", "do", "else", "elif", "if", "while", "until", "!", "time", ";;", ")", "ASSIGN")
        if not r.move(at, c["EOF"]):
            raise _Bad("unexpected end")
    except _Bad as e:
        return s.count("\n", 0, min(i, n)) + 1, str(e)
    return None


# --- Python

_PY_KW = ("pass break continue return raise from global nonlocal del assert import as if elif else while async for in try finally with except def class match case type "
          "lambda and or not is await yield None True False _").split()
_PY_TOK = re.compile(
    r"[ \t\f]+|#.*|(?P<s>(?:[rRbBuU]|[rR][bB]|[bB][rR]|[fF]|[rR][fF]|[fF][rR]|[tT])?(?:'''|\"\"\"|'|\"))|[^\W\d]\w*"
    r"|(?P<n>(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*)?\.?\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?P<bad>\w*))"
    r"|\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|<<|>>|[+\-*/%@&|^<>=]=|[-+*/%@&|^~<>()\[\]{},:.;=]|\\(?=\r?$)|."
)


@cache
def _py_codes() -> dict[str, int]:
    c = recogniser("python").codes
    d = {k: c[k] for k in _PY_KW if k in c}
    for k in "( ) [ ] { } , : . ; = ... -> := ** | + - * / @".split():
        d[k] = c[k]
    for k in "+= -= *= /= %= @= &= |= ^= <<= >>= //= **=".split():
        d[k] = c["AUG"]
    for k in "== != < > <= >=".split():
        d[k] = c["CMP"]
    for k in "% & ^ << >> //".split():
        d[k] = c["OP"]
    d["~"] = c["TILDE"]
    return d


def _py_string_end(text: str, i: int, quote: str) -> int:
    """Behind the closing quote, or -1."""
    n, q = len(text), len(quote)
    while i < n:
        ch = text[i]
        if ch == "\\":
            i += 2
        elif q == 1 and ch == "\n":
            return -1
        elif text.startswith(quote, i):
            return i + q
        else:
            i += 1
    return -1


def _py_fstring_end(r: Recogniser, text: str, i: int, quote: str, raw: bool, spec: bool = False) -> int:
    """Behind the closing quote of a formatted string (before the brace that ends a format), or -1; its fields are read as expressions."""
    n, q = len(text), len(quote)
    while i < n:
        ch = text[i]
        if ch == "\\" and not spec:
            if text.startswith("N{", i + 1) and not raw:
                i = text.find("}", i)
                if i < 0:
                    return -1
                i += 1
            else:
                i += 1 if text[i + 1 : i + 2] in ("{", "}") else 2
        elif text.startswith(quote, i):
            return -1 if spec else i + q
        elif q == 1 and ch == "\n":
            return -1
        elif not spec and (text.startswith("{{", i) or text.startswith("}}", i)):
            i += 2
        elif ch == "}":
            return i if spec else -1
        elif ch == "{":
            i = _py_field_end(r, text, i + 1, quote, raw)
            if i < 0:
                return -1
        else:
            i += 1
    return -1


def _py_field_end(r: Recogniser, text: str, i: int, quote: str, raw: bool) -> int:
    """Behind the brace that ends a replacement field, or -1."""
    n, at, depth = len(text), i, 0
    while i < n:
        if text[i] == "\n":
            i += 1
            continue
        m = _PY_TOK.match(text, i)
        t = m.group()
        if m.group("s"):
            own = t.lstrip("rRbBuUfFtT")
            pre = t[: len(t) - len(own)].lower()
            i = _py_fstring_end(r, text, m.end(), own, "r" in pre) if "f" in pre or "t" in pre else _py_string_end(text, m.end(), own)
            if i < 0:
                return -1
            continue
        if depth == 0 and (t in ("!", ":", ":=", "}") or t == "="):
            break
        depth += (t in "([{") - (t in ")]}")
        if depth < 0:
            return -1
        i = m.end()
    expr = text[at:i].strip(" \t\n\f")
    if not expr or _python(r, f"({expr}\n)\n" if expr.startswith("yield") else f"(x, {expr}\n)\n"):
        return -1
    if text.startswith("=", i):
        i += 1
        while text[i : i + 1] in (" ", "\t", "\n") and i < n:
            i += 1
    if text.startswith("!", i):
        m = re.compile(r"![ \t\n]*[sra][ \t\n]*(?=[:}])").match(text, i)
        if not m:
            return -1
        i = m.end()
    if text.startswith(":", i):
        i = _py_fstring_end(r, text, i + 1, quote, raw, True)
    return i + 1 if 0 <= i < n and text[i] == "}" else -1


def _python(r: Recogniser, text: str) -> tuple[int, str] | None:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    c, codes, lines, moves = r.codes, _py_codes(), r.lines, r.moves
    NEWLINE, INDENT, DEDENT, NAME, NUMBER, STRING, BYTES = (c[x] for x in ("NEWLINE", "INDENT", "DEDENT", "NAME", "NUMBER", "STRING", "BYTES"))
    at, indents, depth, joined, i, n, number = r.begin, [(0, 0)], 0, False, 0, len(text), 0
    while i < n:
        number += 1
        j = text.find("\n", i)
        end = n if j < 0 else j
        line = text[i:end]
        if not depth and not joined:
            body = line.lstrip(" \t\f")
            if not body or body[0] == "#":
                i = end + 1
                continue
            lead = line[: len(line) - len(body)].replace("\f", "")
            if lead or len(indents) > 1:
                col = len(lead.expandtabs(8)), len(lead.expandtabs(1))
                top = indents[-1]
                if col != top:
                    if col[0] > top[0] and col[1] > top[1]:
                        indents.append(col)
                        at = r.move(at, INDENT)
                        if not at:
                            return number, "unexpected indent"
                    elif col[0] < top[0] and col[1] < top[1]:
                        while indents[-1][0] > col[0]:
                            indents.pop()
                            at = r.move(at, DEDENT)
                            if not at:
                                return number, "expected an indented block"
                        if indents[-1] != col:
                            return number, "unindent does not match"
                    else:
                        return number, "inconsistent tabs and spaces"
        else:
            body = line
        hit = lines.get((at, depth, body))
        if hit is not None:
            at, depth, joined = hit
            i = end + 1
            continue
        key, plain = (at, depth, body), True
        pos = i + (len(line) - len(body))
        joined = False
        while pos < n:
            m = _PY_TOK.match(text, pos)
            if m is None:  # the line break
                break
            t = m.group()
            pos = m.end()
            f = t[0]
            if f in " \t\f#":
                continue
            k = codes.get(t)
            if k is None:
                if m.lastgroup == "s" or m.group("s"):
                    quote = t.lstrip("rRbBuUfFtT")
                    pre = t[: len(t) - len(quote)].lower()
                    e = _py_fstring_end(r, text, pos, quote, "r" in pre) if "f" in pre or "t" in pre else _py_string_end(text, pos, quote)
                    if e < 0:
                        return number, "unterminated string"
                    if "\n" in text[pos:e]:
                        plain = False
                        number += text.count("\n", pos, e)
                        j = text.find("\n", e)
                        end = n if j < 0 else j
                    if "b" in pre and not text.isascii() and not text[pos:e].isascii():
                        return number, "bytes of other characters than ASCII"
                    pos = e
                    k = BYTES if "b" in pre else STRING
                elif m.group("n"):
                    if m.group("bad") and m.group("bad") not in ("and", "or", "if", "in", "is", "else", "for"):
                        return number, "invalid number"
                    if re.match(r"0[0-9_]*[1-9]\Z", t):
                        return number, "invalid number"
                    k = NUMBER
                elif f.isidentifier():
                    k = NAME
                elif f == "\\":
                    joined = True
                    continue
                else:
                    return number, f"unexpected {t[:10]!r}"
            elif f in "([{":
                depth += 1
            elif f in ")]}":
                depth -= 1
                if depth < 0:
                    return number, f"unmatched {f}"
            to = moves.get(at << 9 | k)
            at = r.move(at, k) if to is None else to
            if not at:
                return number, f"unexpected {t[:20]!r}"
        if not depth and not joined:
            at = r.move(at, NEWLINE)
            if not at:
                return number, "unexpected end of line"
        if plain:
            lines[key] = at, depth, joined
        i = end + 1
    if depth or joined:
        return number, "unexpected end"
    for _ in indents[1:]:
        at = r.move(at, DEDENT)
        if not at:
            return number, "expected an indented block"
    if not r.move(at, c["EOF"]):
        return number, "unexpected end"
    return None


# --- JavaScript

_JS_KW = ("this super null true false import export if else for while do continue break return with switch case default throw try catch finally debugger function class extends new var const in instanceof "
          "typeof void delete async of get set static as from let yield await").split()
_JS_TOK = re.compile(
    r"[ \t\f\v\u00a0\ufeff\r]+|//.*|(?P<c>/\*)|(?P<q>[\"'])|(?P<t>`)|[A-Za-z_$\u0080-\uffff\\][\w$\u200c\u200d\\]*|\#[A-Za-z_$][\w$]*"
    r"|(?P<n>(?:0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)(?P<bad>[\w$]*))"
    r"|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[+\-*/%&|^]=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]|."
)
_JS_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_JS_STR = {"'": re.compile(r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"), '"': re.compile(r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"')}
_JS_TPL = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)?")


@cache
def _js_codes() -> dict[str, int]:
    c = recogniser("javascript").codes
    d = {k: c[k] for k in _JS_KW}
    for k in "{ } ( ) [ ] ; , ... => = ? : . ?. ++ -- + - * /".split():
        d[k] = c[k]
    for k in "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split():
        d[k] = c["ASSIGN"]
    for k in "== != === !== < > <= >= << >> >>> ** % & | ^ && || ??".split():
        d[k] = c["BIN"]
    d["!"] = d["~"] = c["UNARY"]
    return d


def _javascript(r: Recogniser, text: str) -> tuple[int, str] | None:
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n").replace("\u2029", "\n")
    if text.startswith("#!"):
        j = text.find("\n")
        text = "" if j < 0 else text[j:]
    c, codes, lines, moves = r.codes, _js_codes(), r.lines, r.moves
    NAME, NUMBER, STRING, REGEX, ASI, DIV, TEMPLATE, THEAD, TMID, TTAIL, PRIVATE = (c[x] for x in "NAME NUMBER STRING REGEX ASI / TEMPLATE THEAD TMID TTAIL PRIVATE".split())
    CLOSE, EOF, INC, DEC = c["}"], c["EOF"], c["++"], c["--"]
    at, i, n, number, stack, held = r.begin, 0, len(text), 0, (), 0  # stack: open braces inside each open template; held: a word that ends its statement at the line's end
    bound = {codes[x] for x in ("return", "break", "continue", "throw", "yield")}

    def take(k: int, nl: bool) -> int:
        nonlocal at
        if nl and (k == INC or k == DEC) and (to := r.move(at, ASI)):
            at = to
        to = r.move(at, k)
        if not to and (nl or k == CLOSE or k == EOF):
            to = r.move(at, ASI)
            to = to and r.move(to, k)
        at = to
        return to

    while i < n:
        number += 1
        j = text.find("\n", i)
        end = n if j < 0 else j
        line = text[i:end]
        key = (at, stack, held, line)
        hit = lines.get(key)
        if hit is not None:
            at, stack, held = hit
            i = end + 1
            continue
        pos, nl, plain = i, True, True
        if held and (to := r.move(at, ASI)):
            at = to
        last = held
        held = 0
        while pos < n:
            m = _JS_TOK.match(text, pos)
            if m is None:
                break
            t = m.group()
            pos = m.end()
            f = t[0]
            if f in " \t\f\v\u00a0\ufeff\r" or t[:2] == "//":
                continue
            k = codes.get(t)
            if f == "/" and t != "/*" and (k == DIV or t == "/="):
                if not r.move(at, k):
                    m = _JS_REGEX.match(text, pos - len(t))
                    to = m and r.move(at, REGEX)
                    if m and (to or nl):
                        pos, k = m.end(), REGEX
            elif k is None:
                if t == "/*":
                    e = text.find("*/", pos)
                    if e < 0:
                        return number, "unterminated comment"
                    if "\n" in text[pos:e]:
                        plain, nl = False, True
                        number += text.count("\n", pos, e)
                    pos = e + 2
                    j = text.find("\n", pos)
                    end = n if j < 0 else j
                    continue
                if f in "'\"":
                    m = _JS_STR[f].match(text, pos - 1)
                    if not m:
                        return number, "unterminated string"
                    pos, k = m.end(), STRING
                    if "\n" in m.group():
                        plain = False
                        number += m.group().count("\n")
                        j = text.find("\n", pos)
                        end = n if j < 0 else j
                elif f == "`":
                    m = _JS_TPL.match(text, pos)
                    if not m.group(1):
                        return number, "unterminated template"
                    pos = m.end()
                    k = TEMPLATE if m.group(1) == "`" else THEAD
                    if k == THEAD:
                        stack += (0,)
                elif m.group("n"):
                    if m.group("bad"):
                        return number, "invalid number"
                    k = NUMBER
                elif f == "#" and len(t) > 1:
                    k = PRIVATE
                elif f.isalpha() or f in "_$\\" or ord(f) > 127:
                    k = NAME
                else:
                    return number, f"unexpected {t[:10]!r}"
                if k in (TEMPLATE, THEAD) and "\n" in m.group():
                    plain = False
                    number += m.group().count("\n")
                    j = text.find("\n", pos)
                    end = n if j < 0 else j
            elif f == "{" and stack:
                stack = (*stack[:-1], stack[-1] + 1)
            elif f == "}" and stack:
                if stack[-1]:
                    stack = (*stack[:-1], stack[-1] - 1)
                else:
                    m = _JS_TPL.match(text, pos)
                    if not m.group(1):
                        return number, "unterminated template"
                    pos = m.end()
                    k = TMID
                    if m.group(1) == "`":
                        k, stack = TTAIL, stack[:-1]
                    if "\n" in m.group():
                        plain = False
                        number += m.group().count("\n")
                        j = text.find("\n", pos)
                        end = n if j < 0 else j
            to = None if nl else moves.get(at << 9 | k)
            if to:
                at = to
            elif not take(k, nl):
                return number, f"unexpected {t[:20]!r}"
            nl, last = False, k
        held = last if last in bound else 0
        if plain:
            lines[key] = at, stack, held
        i = end + 1
    if stack or not take(EOF, True):
        return number, "unexpected end"
    return None
