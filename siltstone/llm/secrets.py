"""Problem 2: credentials in code, configuration and prose.

A literal is a candidate by its place: assigned to a name that speaks of a
credential, in a URL's user part, in an authorization header, in a flag, next to
such words in a comment or in prose, or by a key format's own prefix. The
literal (pieces put together, encodings undone) is segmented by Viterbi into
dictionary words, numbers and single unexplained characters; what stays
unexplained decides: long residuals are secrets. In a password's place a short
residual is enough, as people build passwords from words and a few digits.
Known hash formats count only where the name says key, token or secret;
placeholders, masks, references, patterns and public keys never count.

The dictionary is the alphabetic part of a public BPE vocabulary, read from its
file (a parameter); its ranks give the words' costs.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections.abc import Iterator
from functools import cache

from siltstone.functions.arrow import shipped

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # shipped to the executors by name, see ``arrow.ship_file``

# --- dictionary and Viterbi


@cache
def dictionary(path: str = VOCABULARY) -> dict[str, float]:
    """Lower-case word of three letters or more -> cost in bits."""
    words: dict[str, float] = {}
    with open(shipped(path), "rb") as f:
        for line in f:
            a, rank = line.split()
            w = base64.b64decode(a)
            # a leading blank marks a whole word; bare pieces count from four letters on
            whole = w[:1] == b" "
            w = w.strip()
            if len(w) >= (3 if whole else 4) and w.isalpha() and w.isascii():
                t = w.decode().lower()
                words.setdefault(t, 8 + math.log2(2 + int(rank)) / 2)
    return words


UNEXPLAINED = 7.0  # bits for a character that no word explains
LONGEST = 14


def residual(text: str, path: str = VOCABULARY) -> int:
    """Characters of ``text`` that the cheapest segmentation leaves unexplained.

    Separators are free. A digit is unexplained unless it stands in a short run
    (four at most) that ends a word or the text.
    """
    words = dictionary(path)
    n, low = len(text), text.lower()
    cost = [0.0] + [1e9] * n
    left = [0] * (n + 1)
    for i in range(n):
        c, r = cost[i], left[i]
        ch = text[i]
        step = 0.5 if ch in "_-. /:@" else UNEXPLAINED
        if c + step < cost[i + 1]:
            cost[i + 1], left[i + 1] = c + step, r + (step == UNEXPLAINED)
        if ch.isalpha():
            for j in range(i + 3, min(n, i + LONGEST) + 1):
                w = words.get(low[i:j])
                if w is None:
                    continue
                s = text[i:j]
                # words are lower, upper or title case; other mixtures are chance
                if not (s.islower() or s.isupper() or s[1:].islower()):
                    continue
                if c + w < cost[j]:
                    cost[j], left[j] = c + w, r
    return left[n]


# --- what can't be a credential

PLACEHOLDER = re.compile(
    r"\$\{|\$\(|\{\{|<[^<>]*>|\.\.\.|…|%\(|%s|%\{|^\$\w|(?:x|X|\*|0|\.|-|#|•){6,}|process\.env|os\.environ|getenv|import\.meta"
    r"|(?i:your[-_ ]|change[-_ ]?me|replace[-_ ]?me|example|placeholder|dummy|redacted|insert[-_ ]|todo|goes[-_ ]here|not[-_ ]?a[-_ ]?real|sample[-_]?(?:key|token)|^my[-_])"
)
PATTERN = re.compile(r"\[[^\]]*[A-Za-z0-9]-[A-Za-z0-9][^\]]*\][+*{]|\\[wdsSWDb]|\{\d+,?\d*\}|\(\?[:!=P<]|\.\*")
HASHES = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})\Z")
UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z")
SRI = re.compile(r"(?i)(?:sha\d+|md5|blake2b?)[-:=]")
HASH_NAME = re.compile(
    r"(?i)sha\d|md5|hash|digest|checksum|chk_?sum|build_?sum|(?:^|[_-])sum(?:$|[_-])|integrity|signature(?!_?key)|(?:^|_)etag|revision|commit|(?:^|[_-])rev(?:$|[_-])|(?:^|[_-])ref(?:$|[_-])|image_?id|trace|fingerprint|public|pub_?key|request_?id|uuid|nonce"
)
NOT_A_VALUE_NAME = re.compile(r"(?i)(?:file|path|dir|name|names|limit|mode|level|step|pattern|regex|re|field|header|type|url|uri|env|var|length|len|size|count|ttl|expiry|expires|id_field|prefix|format|endpoint|list|text)\d*\Z")
FORMAT = re.compile(
    r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{16,}|github_pat_\w{20,}|glpat-[\w-]{16,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{12,}"
    r"|xox[abeprs]-[A-Za-z0-9-]{16,}|AIza[\w-]{25,}|npm_[A-Za-z0-9]{20,}|pypi-[\w-]{16,}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{20,}|ey[JI][\w-]{8,}\.[\w-]{8,}\.[\w-]{6,})"
)
FORMAT_PREFIX = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-proj-|sk-ant-|sk-|[sr]k_(?:live|test)_|xox[abeprs]-|AIza|npm_|pypi-|hf_)")

# --- places

WORDS = (
    r"pass(?:word|wd|phrase|code)?|pwd|secret|token|creds?|credentials?|api[_\- .]?key|access[_\- .]?key(?:[_\- .]?id)?|private[_\- .]?key|key|auth(?:orization)?|bearer|jwt|pat|dsn"
)
NAME = re.compile(rf"(?i)(?:{WORDS})")
PASSWORD_NAME = re.compile(r"(?i)pass(?:word|wd|phrase|code)?(?![a-z])|pwd")
#: a name, what binds it to a value, and the value's quote or first character
ASSIGN = re.compile(
    r"(?<![\w$.])(?<![\w$.]-)(?P<name>[\w$@][\w$.\-]*+)(?P<post>[\"'`\]]{0,3})[ \t]*(?P<op>:=|=>|=(?!=)|:(?![:/=])|,|\?\?=?|\|\|=?)[ \t]*(?P<q>[rbuf]{0,2}[\"'`]|(?=[^\s\"'`]))"
)
URL_USER = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]{1,20}://(?P<u>[^\s/:@\"'`<>]*):(?P<p>[^\s/@\"'`<>]{3,}+)@(?=[\w\[.-])")
AUTH = re.compile(r"(?i)\b(?P<s>basic|bearer|token|apikey|digest)[ \t]+(?P<v>[^\s\"'`,;<>(){}]{8,})")
HEADER = re.compile(r"(?i)\b(?P<h>(?:x-)?(?:[a-z]+-)*(?:auth|authorization|token|key|secret|api-?key|password)(?:-[a-z]+)*)[\"'`]?[ \t]*:[ \t]*[\"'`]?(?P<v>[^\s\"'`]{8,})")
FLAG = re.compile(r"(?i)(?<![\w-])--?(?P<name>[a-z-]*(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|user)[a-z-]*)(?:=|[ \t]+)(?P<q>[\"']?)(?P<v>[^\s\"']{6,})")
PROSE = re.compile(r"(?i)\b(?:pass(?:word|wd|phrase|code)?|secret|token|credentials?|(?:api|access|account|signing|encryption|service|geo|llm|model|maps|payment)?[ _-]?key(?:[ _]id)?|apikey|jwt|pat|pwd)\b")
RUN = re.compile(r"[A-Za-z0-9!@#$%^&*][A-Za-z0-9+/=_.\-~!@#$%^&*]{6,}[A-Za-z0-9=!@#$%^&*/+]")
STOP = re.compile(r"[.!?;](?=\s)|\s[|]\s")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_BODY = re.compile(r"(?:\\r|\\n|\s|[\"'+,>|#]|(?:[A-Za-z-]+:[^\n\\]++))*[A-Za-z0-9+/]{16}")
KEY_LINE = re.compile(r"[A-Za-z0-9+/]{1,64}")
PIECE = re.compile(r"[ \t]*(?:\+|,|\.|&|\\?\n)?[ \t]*(?:\\?\n[ \t]*)?(?:\+|,)?[ \t]*[rbuf]{0,2}([\"'`])((?:(?!\1)[^\\\n])*)\1")
CODE_VALUE = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*(?:[(\[{]|$)|[\[({\d+\-!]")
#: a line without one of these (in lower case) has no place for a credential
PLACES = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "jwt", "pat", "dsn", "user", "-u ", "-u\t", "cred", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "k_live_", "k_test_", "xox", "aiza", "npm_", "eyj", "eyi", "glpat", "sg.", "hf_", "pypi-", "github_pat", "basic ", "basic\t", "digest ", "digest\t")
#: a literal without one of the names: long and of the characters that keys are made of, bound to any name
ANY_NAME = re.compile(r"[=:(,>\[][ \t]*[rbuf]{0,2}(?P<q>[\"'`])(?P<v>[A-Za-z0-9+/_\-.~]{20,}={0,2})(?P=q)")
LONG_RESIDUAL, LONG_SHARE = 16, 0.5
#: a short literal that something may be joined to
JOINED = re.compile(r"[\"'`][^\"'`\n]{0,5}[\"'`][ \t]*(?:[+,.&\\\"'`]|\r?\Z)")
SUSPECT = re.compile(r"[A-Za-z0-9_!@#$%^&*+/~.\-]{6,}")
CAMEL = re.compile(r"(?:[A-Za-z][a-z]{2,}|[A-Z]{2,})(?:[_.\-/]?[A-Z][a-z]{2,}|[_.\-/][a-z]{2,})*\Z")
OPEN_END = (":", "=", "(", "\\", "[", "|", ">-", ">", ",", "|-")


def _suspicious(line: str) -> bool:
    """Whether a run of characters in the line is more than a plain name, or a short literal may be one of several pieces."""
    for v in SUSPECT.findall(line):
        if v.isdigit() or v.islower() and v.isalpha():
            continue
        if not CAMEL.match(v):
            return True
    return JOINED.search(line) is not None


def _mixed(v: str) -> int:
    return any(c.isdigit() for c in v) + any(c.islower() for c in v) + any(c.isupper() for c in v) + any(not c.isalnum() for c in v)


def secret_value(v: str, name: str, place: str) -> bool:
    """Whether ``v`` is a credential in a place: password, assign, header, prose or format."""
    if len(v) < 6 or PLACEHOLDER.search(v) or PATTERN.search(v) or any(c.isspace() for c in v):
        return False
    if v[0] in "/~." and ("/" in v[1:]) and re.fullmatch(r"[~.]?/?(?:[\w.-]+/)+[\w.-]*|/[\w.-]+", v) and residual(v) < 16:
        return False
    if SRI.match(v) or v.startswith(("data:", "http://", "https://", "file:", "ssh-", "sha")) or len(set(v)) < 5:
        return False
    f = FORMAT.fullmatch(v)
    if f:
        body = FORMAT_PREFIX.sub("", v, count=1)
        return residual(body) >= 4 and len(set(body)) > 6
    if HASHES.match(v) or UUID.match(v):
        return place != "format" and not HASH_NAME.search(name) and bool(NAME.search(name)) and not UUID.match(v)
    if HASH_NAME.search(name):
        return False
    left = residual(v)
    if place == "password":
        return _mixed(v) >= 2 and (left >= 2 and any(c.isdigit() for c in v) or left >= 4)
    if place in ("assign", "header"):
        if left >= 10 and len(v) >= 14:
            return True
        return place == "header" and _mixed(v) >= 2 and (left >= 2 and any(c.isdigit() for c in v) or left >= 6)
    return left >= 12 and len(v) >= 16


def keylike(v: str, name: str) -> bool:
    """Whether a literal bound to a name that says nothing is a key: long, of letters in both cases and digits, most of it unexplained."""
    if not name or HASH_NAME.search(name) or NOT_A_VALUE_NAME.search(name) or SRI.match(v) or UUID.match(v) or HASHES.match(v) or PLACEHOLDER.search(v):
        return False
    if not (any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v)) or len(set(v)) < 12:
        return False
    if _decode(v):  # text, encoded
        return False
    left = residual(v)
    return left >= LONG_RESIDUAL and left >= LONG_SHARE * len(v)


def find(text: str | None) -> list[tuple[int, list[tuple[int, int]], str]]:
    """Credentials of a text: (line from 1, spans of its literal pieces, kind), in order.

    Null or empty text has none. Lines are split at ``\\n``.
    """
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    starts = set()
    for w in PLACES:
        i = low.find(w)
        while i >= 0:
            starts.add(text.rfind("\n", 0, i) + 1)
            e = text.find("\n", i)
            if e < 0:
                break
            if text[max(0, e - 3) : e].rstrip("\r \t").endswith(OPEN_END):
                starts.add(e + 1)
            i = low.find(w, e)
    i = text.find("://")
    while i >= 0:
        e = text.find("\n", i)
        e = len(text) if e < 0 else e
        if text.find("@", i, e) > 0:
            starts.add(text.rfind("\n", 0, i) + 1)
        i = text.find("://", e)
    starts.update(text.rfind("\n", 0, m.start("v")) + 1 for m in ANY_NAME.finditer(text))
    out: list[tuple[int, list[tuple[int, int]], str]] = []
    number, at, skip_to = 1, 0, 0
    for a in sorted(starts):
        e = text.find("\n", a)
        e = len(text) if e < 0 else e
        if e - a < 3 or e <= skip_to or not _suspicious(text[a:e]):
            continue
        before = text[text.rfind("\n", 0, a - 1) + 1 : a - 1] if a else ""
        taken: list[tuple[list[tuple[int, int]], str]] = []
        for spans, kind in _line(text, max(a, skip_to), e, before):
            if all(y <= u or x >= v for x, y in spans for s, _ in taken for u, v in s):
                taken.append((spans, kind))
        if taken:
            number += text.count("\n", at, a)
            at = a
            out += [(number, spans, kind) for spans, kind in sorted(taken)]
            skip_to = max(skip_to, *(spans[-1][1] for spans, _ in taken))
    return out


def _line(text: str, a: int, e: int, before: str) -> Iterator[tuple[list[tuple[int, int]], str]]:
    line = text[a:e]
    if "PRIVATE KEY" in line:
        for m in PEM.finditer(line):
            i = a + m.end()
            body = PEM_BODY.match(text, i)
            rest = text[i : i + 3]
            if body and not _unexplained(text, body.end() - 16):
                continue
            if body and not PLACEHOLDER.search(text[body.end() - 16 : body.end() + 24].split("\n")[0]):
                end = PEM_END.search(text, i)
                nxt = PEM.search(text, i)
                stop = end.start() if end and (not nxt or end.start() < nxt.start()) else _pem_stop(text, i)
                yield [(i, stop)], "private key"
            elif not rest.strip(" \r\n'\"`;,)\\n") and i >= len(text.rstrip()) - 3 and not PATTERN.search(line) and not re.search(r"(?i)grep|match|search|pattern|includes|startswith|compile|test\(", line):
                yield [(a + m.start(), i)], "private key"
    for m in URL_USER.finditer(line):
        v = m.group("p")
        plain = _unquote(v)
        if secret_value(plain, "password", "password"):
            yield [(a + m.start("p"), a + m.end("p"))], "url password"
    for m in AUTH.finditer(line):
        s, v = m.group("s").lower(), m.group("v")
        if s in ("basic", "digest"):
            d = _decode(v)
            if d and ":" in d:
                w = d.split(":", 1)[1]
                if secret_value(w, "password", "password") or secret_value(w, "token", "assign"):
                    yield [(a + m.start("v"), a + m.end("v"))], "basic authorization"
        elif secret_value(v, s, "header" if re.search(r"(?i)authoriz|header|-h\b|curl|bearer", line) else "prose"):
            yield [(a + m.start("v"), a + m.end("v"))], "authorization header"
    for m in HEADER.finditer(line):
        v = m.group("v").rstrip(",;)}")
        if not FORMAT.match(v) and ("x-" not in m.group("h").lower() and "curl" not in line and "eader" not in line):
            continue
        if secret_value(v, m.group("h"), "header"):
            yield [(a + m.start("v"), a + m.start("v") + len(v))], "header"
    for m in FLAG.finditer(line):
        v, name = m.group("v").rstrip("\"'`;,)"), m.group("name")
        at = a + m.start("v")
        if name.lower() in ("user", "u") or name.lower().endswith("user"):
            if ":" not in v:
                continue
            at, v, name = at + v.index(":") + 1, v.split(":", 1)[1], "password"
        if secret_value(v, name, "password" if PASSWORD_NAME.search(name) else "header"):
            yield [(at, at + len(v))], "flag"
    for m in re.finditer(r"(?<!\w)-u[ \t]+[\"']?[\w.@-]+:([^\s\"':]{6,})", line):
        if secret_value(m.group(1), "password", "password"):
            yield [(a + m.start(1), a + m.end(1))], "flag"
    for m in ASSIGN.finditer(line):
        name = m.group("name")
        if not NAME.search(name) and not (m.group("op") == "," and NAME.search(name)):
            continue
        yield from _assigned(text, a, e, line, m, name)
    last = before.rstrip()
    if last.endswith(OPEN_END):
        name = _name_at_end(last)
        if name and NAME.search(name):
            q = re.match(r"[ \t]*[rbuf]{0,2}(?:([\"'`])([^\s\"'`,;]+)|()([^\s\"'`,;]{6,}))", line)
            if q:
                k = 2 if q.group(1) else 4
                spans = [(a + q.start(k), a + q.end(k))]
                v = q.group(k)
                if q.group(1):
                    v, spans = _pieces(text, a + q.start(2), q.group(1), e)
                if _judge(v, name, bool(q.group(1))):
                    yield spans, "assignment"
    for m in ANY_NAME.finditer(line):
        name = _name_at_end(line[: m.start() + 1].replace("(", "=").replace("[", "=").replace(">", "=")) if m.group()[0] != "," else ""
        if keylike(m.group("v"), name) and not PATTERN.search(line):
            yield [(a + m.start("v"), a + m.end("v"))], "assignment"
    for m in FORMAT.finditer(line):
        i = m.start()
        if i and (line[i - 1].isalnum() or line[i - 1] in "_"):
            continue
        if secret_value(m.group(), "", "format") and not PATTERN.search(line[i : m.end() + 6]):
            spans = [(a + i, a + m.end())]
            if i and line[i - 1] in "\"'" and line[m.end() : m.end() + 1] == line[i - 1]:
                spans = _pieces(text, a + i, line[i - 1], e)[1]
            yield spans, "format"
    if (w := PROSE.search(line)):
        prose = line
        comment = re.search(r"(?:^|\s)(?:#|//|/?\*|--|;|REM\b|<!--)|`|\"\"\"|^[A-Z][a-z]+ |^\s*[-*>] ", prose)
        if comment:
            for m in RUN.finditer(line):
                v = m.group().rstrip(".")
                if len(v) < 8:
                    continue
                near = _sentence(line, m.start(), m.end())
                k = PROSE.search(near)
                if not k or HASH_NAME.search(near):
                    continue
                if line[m.start() - 1 : m.start()] in ("/", ".", "$", "{", "(", "@") and not FORMAT.match(v):
                    continue
                pw = PASSWORD_NAME.search(near)
                if HASHES.match(v):
                    ok = bool(re.search(r"(?i)key|token|secret", k.group())) and not PATTERN.search(line)
                elif pw:
                    ok = secret_value(v, "password", "password") and (any(c.isdigit() for c in v) or residual(v) >= 6) and (line[m.start() - 1 : m.start()] in "`\"' :" and re.search(r"(?i)password|passwd|pwd|pass\b|passphrase", near) is not None)
                else:
                    ok = secret_value(v, k.group(), "prose")
                if ok and "(" not in v:
                    yield [(a + m.start(), a + m.start() + len(v))], "prose"


def _sentence(line: str, i: int, j: int) -> str:
    """What stands around i..j in its sentence."""
    start = max((m.end() for m in STOP.finditer(line, 0, i)), default=0)
    end = STOP.search(line, j)
    return line[start:i] + " " + line[j : end.start() if end else len(line)]


def _unexplained(text: str, i: int) -> bool:
    """Whether a key's first line is no plain words."""
    run = KEY_LINE.match(text, i).group()
    return residual(run) >= 0.3 * len(run)


def _pem_stop(text: str, i: int) -> int:
    m = re.compile(r"(?:\\r|\\n|[\s\"'+,]|[A-Za-z0-9+/=]{16,}|[A-Za-z0-9+/=]+(?=\s*(?:\\n|\n|\Z|\"|'|`)))*").match(text, i)
    return m.end() if m else i


def _unquote(v: str) -> str:
    if "%" not in v:
        return v
    from urllib.parse import unquote

    return unquote(v)


def _decode(v: str) -> str | None:
    try:
        d = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode()
    except (binascii.Error, ValueError):
        return None
    return d if d.isprintable() else None


def _name_at_end(s: str) -> str:
    """The name that the end of a line binds to the next; read backwards, so that a long line costs no more than its end."""
    t = s[:-1] if s.endswith("-") and s[-2:-1] in tuple("([|>\\") else s
    t = (t[:-1] if t.endswith(tuple("([|>\\")) else s).rstrip()
    if not t.endswith((":", "=", ",")):
        return ""
    t = t[:-1].rstrip().rstrip("\"'`]")
    i = len(t)
    while i and (t[i - 1] in "_.-" or t[i - 1].isalnum()):
        i -= 1
    while i < len(t) and not (t[i] == "_" or t[i].isascii() and t[i].isalpha()):
        i += 1
    return t[i:]


def _pieces(text: str, i: int, q: str, e: int) -> tuple[str, list[tuple[int, int]]]:
    """The literal at i (behind its quote) and those joined to it."""
    j = i
    while j < len(text) and text[j] != q and text[j] != "\n":
        j += 2 if text[j] == "\\" else 1
    parts, spans = [text[i:j]], [(i, j)]
    at = j + 1
    while True:
        m = PIECE.match(text, at)
        if not m:
            break
        glue = text[at : m.start(1)]
        if not glue.strip(" \trbuf") and "\n" not in glue and not (q in "\"'" and glue.strip(" \t") == ""):
            break
        if "," in glue and "[" not in text[max(0, i - 4) : i]:
            break
        if "\n" in glue and "+" not in glue and "," not in glue and "(" not in text[max(0, i - 6) : i] and "\\" not in glue and not re.search(r"[(\[]\s*$", text[max(0, i - 40) : i - 1]):
            break
        parts.append(m.group(2))
        spans.append((m.start(2), m.end(2)))
        at = m.end()
    return "".join(parts), spans


def _judge(v: str, name: str, quoted: bool) -> bool:
    if NOT_A_VALUE_NAME.search(name) and not FORMAT.fullmatch(v) and not URL_USER.match(v):
        return False
    if PASSWORD_NAME.search(name):
        return secret_value(v, name, "password")
    if secret_value(v, name, "assign"):
        return True
    d = _decode(v) if len(v) >= 12 else None
    return bool(d) and (bool(FORMAT.fullmatch(d)) and secret_value(d, name, "assign") or ":" in d and secret_value(d.split(":", 1)[1], name, "password"))


def _assigned(text: str, a: int, e: int, line: str, m: re.Match, name: str) -> Iterator[tuple[list[tuple[int, int]], str]]:
    i, q, op = a + m.end(), m.group("q"), m.group("op")
    tail = name.rsplit(".", 1)[-1]
    if q:
        quote = q[-1]
        if op == "," and quote == "`":
            return
        v, spans = _pieces(text, i, quote, e)
        if _judge(v, tail, True):
            yield spans, "assignment"
        return
    # no quote: an array of pieces, a call around the literal, a fallback, or a bare value
    rest = text[i:e]
    k = re.match(r"[\[(]\s*[rbuf]{0,2}([\"'`])", rest)
    if k:
        v, spans = _pieces(text, i + k.end(), k.group(1), e)
        if _judge(v, tail, True):
            yield spans, "assignment"
        return
    k = re.match(r"[^\"'`#;]*?(?:\|\||\?\?|\bor\b|(?:b64decode|atob|from|decode|encode|bytes|String|str|Buffer\.from|get|getenv|setdefault)\((?:[^\"'`()]*[\"'`][\w.]+[\"'`]\s*,)?)\s*[rbuf]{0,2}([\"'`])", rest)
    if k:
        v, spans = _pieces(text, i + k.end(), k.group(1), e)
        if _judge(v, tail, True):
            yield spans, "assignment"
        return
    if op == ",":
        return
    v = re.match(r"[^\s\"'`]*", rest).group().rstrip(",;")
    if not v or op in ("||", "??", "=>"):
        return
    bare = rest[len(v) :].strip()
    if bare and not bare.startswith(("#", "//", ";", ",", "&&", "\\", "|", "}", ")", "\"", "'", "`")) and op == ":":
        return
    if CODE_VALUE.match(v) and re.search(r"[(\[{]", v):
        return
    if re.fullmatch(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+", v) and not FORMAT.fullmatch(v) and residual(v) < 12:
        return
    if _judge(v, tail, False):
        yield [(i, i + len(v))], "assignment"


def redact(text: str | None, mark: str = "REDACTED") -> tuple[str | None, int]:
    """The text with each credential's literal replaced, and how many.

    Quotes, separators, line breaks and key frames stay, so the code keeps its form.
    """
    found = find(text)
    if not found:
        return text, 0
    out, at = [], 0
    for s, e in sorted({x for f in found for x in f[1]}):
        if s < at:
            continue
        out.append(text[at:s])
        out.append(re.sub(r"(?:(?!\\n|\\r)[^\s\"'`,+\\])+(?=\\[nr]|\s|[\"'`,+\\]|\Z)", mark, text[s:e]) if re.search(r"\s|\\n", text[s:e]) else mark)
        at = e
    out.append(text[at:])
    return "".join(out), len(found)
