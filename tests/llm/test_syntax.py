"""The table-driven recogniser against Python's own parsers and on hand-made cases."""

import ast
import json
import random
import tomllib
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm.chart import Grammar, Recogniser
from siltstone.llm.invalid_source import error_rates, language_of, syntax_errors
from siltstone.llm.syntax import first_error

GOOD = {
    "python": ["", "x = 1\n", "def f(a, /, b=2, *c, d: int = 3, **e) -> None:\n    return [x async for x in y]\n", "match x:\n    case [1, *_] if y: pass\n    case {'a': b, **r}: pass\n", "with (a as b, c as d):\n    pass\n",
               "f'{x!r:>{w}} {y}'\n", "x = '''\n<<<<<<< HEAD\n'''\n", "print(*a, **b, sep='')\nlambda *, k: k\n", "type X[T] = list[T]\nasync def f():\n    await g()\n", "a = b = yield_ = 1 if x else 2\n", "try:\n    pass\nexcept* E as e:\n    pass\nfinally:\n    pass\n"],
    "javascript": ["", "import a, {b as c} from 'x'\nexport default class A extends B { static #p = 1; get x() { return this.#p } }", "const {a, ...b} = {c, [d]: 1, e() {}}\nfor (const x of y) z\n", "let r = /[/]x/g.test(s) ? a / b / c : `t${`u${v}`}w`", "async (x) => { await x }\nlabel: for (;;) break label\n",
                   "var a = 1\n++b\nreturn_ = function* () { yield* x }\n", "if (a) b; else c\ndo x++; while (x < 5) y()", "(a, b = 2, ...c) => ({d})", "#!/usr/bin/env node\nx?.y?.[0]?.(1) ?? z"],
    "bash": ["", "for i in a b; do echo \"$i $(ls | wc -l)\"; done", "case $x in a|b) echo ;; *) ;; esac", "f() { cat <<'E' | sort\n}}\nE\n}", "a=(1 2\n3); [[ $x =~ ^(a|b)$ && -f y ]] && ((x++))", "if ! test x; then :; elif y; then z; else w; fi > out 2>&1", "echo if then ${x:-\"a b\"} $((1+2)) `date`"],
    "json": ["{}", '[1, -2.5e3, "a\\u00e9", {"b": null}]'],
    "yaml": ["", "a: 1\nb:\n- x\n- y: z\n", "x: [a, {b: c}]\ny: |\n  text: :\n  - more\nz: \"q: r\"\n", "---\na: &x 1\nb: *x\n...\n---\n- 1\n", "k: multi\n  line\n# c\n? a\n: b\n"],
    "toml": ["", "a = 1\nb.c = 'x'\n[t]\nd = [1,\n 2,\n]\n[[u]]\ne = {f = 1979-05-27T07:32:00Z, g = \"h\"}\n"],
}
BAD = {
    "python": ["def f(:\n", "x = (1\n", "if x:\npass\n", "<<<<<<< HEAD\nx = 1\n", "print 'x'\n", "x = 'a\n", "  x = 1\n", "def f():\n    x\n   y\n", "a = 1 +\n"],
    "javascript": ["function f( {", "const x;", "<<<<<<< ours\nlet a", "let a = ;", "x = `a", "if (a {", "class { x = }", "import x\n", "{\"a\": 1}"],
    "bash": ["if true; then echo", "for i in a; do", "echo 'x", "foo() {", "case x in", "<<<<<<< HEAD\nx", "a | | b", "echo (x)", "fi"],
    "json": ["", "{", "{'a': 1}", "[1,]", '{"a": 1,}', "// c\n{}", "NaN"],
    "yaml": ["a: [1\n", "a: b: c\n", "x: 'q\n", "a: 1\n<<<<<<< HEAD\nb: 2\n", "a:\n\tb: 1\n", "- a\nb: 1\n", "k: \"x\" y\n"],
    "toml": ["a =\n", "[t\n", "a = 'x\n", "a = 1\na = 2\n", "<<<<<<< x\n", "a b = 1\n"],
}


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in GOOD.items() for t in v])
def test_valid(lang, text):
    assert first_error(lang, text) is None
    assert first_error(lang, text.replace("\n", "\r\n")) is None or "'''" in text


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in BAD.items() for t in v])
def test_invalid(lang, text):
    assert first_error(lang, text) is not None


def test_every_truncation_of_python_and_json():
    src = "import os\n\nclass A(B):\n    def f(self, x=1):\n        if x > 1 and (y := g(x)):\n            return {'a': [i for i in x if i]}\n        return 'z'\n"
    for n in range(len(src)):
        try:
            ast.parse(src[:n])
            want = True
        except SyntaxError:
            want = False
        assert (first_error("python", src[:n]) is None) == want, src[:n]


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12))
def test_json_of_any_value(value):
    text = json.dumps(value)
    assert first_error("json", text) is None
    if len(text) > 2 and text[0] in "[{":
        assert first_error("json", text[:-1]) is not None


@pytest.mark.parametrize("text", ["for ((i=0; i<n; i++)); do echo $i; done", "for((;;)) do break; done", "for (( i = $(echo '1;2'; echo); i < (2 + 3); i++ ))\n{ x; }", "if a; then for ((i=0; i < ${#x[@]}; i++))\ndo y; done; fi", "for ((i=0; i<n; i++) ); do x; done"])
def test_bash_arithmetic_for(text):
    assert first_error("bash", text) is None
    assert first_error("bash", text.replace("\n", "\r\n")) is None
    assert first_error("bash", text[:-4]) is not None


@pytest.mark.parametrize("text", ["for ((i=0; i<n)); do x; done", "for ((i=0; i<n; i++)) echo", "echo for ((i=0; i<n; i++))", "select ((i=0; i<n; i++)); do x; done", "for ( (i=0; i<n; i++)); do x; done"])
def test_bash_arithmetic_for_is_invalid(text):
    assert first_error("bash", text) is not None


def test_ambiguous_grammar():
    r = Recogniser(Grammar("s: e EOF ; e: t ('+' t)* ; t: 'a' | '(' e ')' | '(' e ')' 'b' ;", "s"))
    at = r.begin
    for x in ["(", "a", "+", "a", ")", "b", "EOF"]:
        at = r.move(at, r.codes[x])
    assert at and not r.move(r.begin, r.codes["+"])


def test_table(spark):
    rows = [(1, "s", "a.py", "x = ("), (2, "s", "b.PY", "x = 1"), (3, "s", "tool", "#!/usr/bin/env python3\nx ="), (4, None, None, "x = ("), (5, "s", "c.json", None), (6, "s", "d.py", ""), (7, "s", "e.md", "x = ("), (8, "s", "big.py", "x = 1\n" * 20000)]
    t = spark.createDataFrame(rows, "file_id long, skill_name string, path string, content string").withColumn("language", F.lit("none")).withColumn("line_no", F.lit(1))
    assert sorted(r.file_id for r in syntax_errors(t).collect()) == [1, 3, 5]
    assert syntax_errors(t.limit(0)).count() == 0
    rate = {r.language: (r.n_files, r.n_invalid) for r in error_rates(t).collect()}
    assert rate == {"python": (5, 2), "json": (1, 1)}
    assert t.select(language_of(F.col("path"), F.col("content")).alias("l")).where("l IS NOT NULL").count() == 6


# --- against Python's own parsers, which the operator itself doesn't use

PYTHON = [
    'f() = 1', '1 += 2', 'None = 2', 'def f(a=1, b): pass', 'del f()', 'def f(*): pass',
    'f(x for x in y, 1)', 'f(a=1, 2)', 'f(**k, *a)', 'a := 1', '[*a for a in b]', '{**a for a in b}',
    'for f() in x: pass', 'with a as f(): pass', 'x = y = 1 = z', '(a, b): int', 'a.b: int = 3', '(a): int',
    'lambda a=1, b: a', '[x for x in a if b else c]', '[x for x in y if a := 1]', '(yield) = 1', 'a + b = c', 'a() += 1',
    '(a, b) += 1', '[a, b] = c', '*a, b = c', '*a = b', 'a if b else c = 1', 'f(a.b=1)',
    'f(True=1)', 'class A(x for x in y): pass', 'def f(a, a): pass', 'def f(a, /, b, /): pass', 'def f(*a, *b): pass', 'def f(**k, a): pass',
    'def f(*, **k): pass', 'def f(a, *, b=1, c, **k): pass', 'import a.b as c.d', 'from . import *', 'x = *a', 'x = *a, b',
    'return *a, b', 'print(*a, **b, c=1)', 'f(*a, b)', 'f(b, *a, c=1, *d, **e)', 'a[b:=1]', 'a[*b]',
    'a[1:2, ::3]', '{a: 1, **b}', '{a, *b}', '{a: 1, b}', '{a: b for a in c}', 'not a in b',
    '1 + not 2', 'a = yield b', 'a = await b', 'try: pass\nexcept A, B: pass', 'try: pass\nexcept (A, B) as e: pass', 'try: pass\nexcept* A: pass\nexcept B: pass',
    'match x:\n case {a: 1}: pass', 'match x:\n case A(b=1, c): pass', 'match x:\n case a.b | 1: pass', 'match x:\n case -1+2j: pass', 'match *a, b:\n case _: pass', 'match(x)',
    'match = 1', 'case = type = _ = 3', 'type X = int', 'type X[T: int = str, *Ts, **P] = T', 'del (a, [b, c.d]), e[1]', 'del *a',
    'assert (a, b)', 'global a.b', 'async def f(): pass', 'async x', '@a.b[1](c)\ndef f(): pass', 'with (a, b): pass',
    'with (a as b, c): pass', 'with (a): pass', 'with a, b as (c, d): pass', 'with (yield a): pass', 'x = (yield)', 'f((yield))',
    'f(yield)', 'lambda *: 1', 'lambda *, k: k', 'lambda a, /, b: a', 'lambda **k: k', 'def f(a, b=1, /, c=2): pass',
    'def f(a, b=1, /, c): pass', 'def f(a=1, /, *, b): pass', 'f(a)(b).c = 1', 'a.b().c[1] += 2', '(a.b) = 1', '(a) += 1',
    '((a)) = ((b)) = 1', 'for a, *b in c: pass', 'for (a) in c: pass', 'for a.b in c: pass', 'for x in *a, b: pass', 'if a := b: pass',
    'while a := f(): pass', 'x = a := b', 'f(a := b)', 'f(a := b, c)', 'f(a for a in b)', 'f((a for a in b), c)',
    'f(c, a for a in b)', 'f(a for a in b,)', "print 'x'", "exec 'x'", 'a <> b', '0777',
    '1__0', '1_0', '0x_f', '1e5j', "'a' b'c'", "f'{a!r:>{b}}'",
    "f'{a'", "f'{}'", "f'{a b}'", "f'{a['b']}'", "f'{{}}'", "f'}'",
    "f'{a!x}'", "f'{a=}'", "f'{a = !r}'", "f'{a:{b}.{c}}'", "f'{a:{b!r:{c}}}'", "f'{lambda x: 1}'",
    "f'{(lambda x: 1)}'", "f'{*a}'", "f'{*a, b}'", "f'{yield a}'", "f'{a:\\n}'", "f'\\{a}'",
    "f'\\N{BULLET}'", "rf'\\{a}'", "rf'\\N{BULLET}'", "f'{\na\n}'", "f'{a #c\n}'", "f'''{a #c\n}'''",
    "f'{a!=b}'", "f'{a==b}'", "f'{a:=5}'", "f'{f'{f'{1}'}'}'", 'f\'{"x"}\' \'y\'', "f'{a}' b'x'",
    "b'é'", '(*a)', '(*a,)', 'f\'{a!r:^{w}}\' f"{b}"', "f'{a['x'", 'f\'{d["}"]}\'',
    "f'{a if b else c}'", "f'{a:%Y-%m}'", "f'{ {1: 2}[1] }'", "f'{a,}'", "f'{!r}'", "f'{a!r'",
    "f'{a:{}}'", "rb'\\x'", "ur'x'", '...', 'a..b', 'a.1',
    '1.a', '1 .a', '1..a', 'if a:\n  b\n c', '\tif a:\n', 'x = 1;',
    'x = 1;;', '; x', 'def f():\n  return\n\n\n', 'def f(): pass; return 1', 'class A: x = 1', 'class A(B, metaclass=C, *d): pass',
    'nonlocal x, y', 'raise a from b', 'raise a, b', 'import a, b as c', 'from a import (b, c as d,)', 'from a import b,',
    'from a import (b, *)', 'from .. a import b', 'from ... import b', 'from a import', 'not = 1', 'True += 1',
    'a, b += 1', 'a = b += 1', 'f(*)', 'f(**)', 'f(,)', '(,)',
    '()', '[]', '{}', '[,]', '(a,)', '(a for b in c for d in e if f if g)',
    '{a for b in c}', 'async for a in b: pass', '[a async for b in c]', 'await a ** b', '-a ** -b', 'a ** -b',
    'a if b', 'a if b else', 'lambda: lambda: 1', 'a < b < c', 'a is not b not in c', 'a not b',
    'a @ b @= c', 'a @= b', 'a -> b', 'a ! b', 'a ? b', '$a',
    'a\\\nb', 'a = \\\n  b', "x = '''a\nb'''", "x = 'a\\\nb'", "'a\nb'", '# only\n',
    'x = 1 # c', 'if a: pass\nelse: pass', 'if a: pass\nelif: pass', 'else: pass', 'try: pass', 'try: pass\nfinally: pass',
    'for a in b: pass\nelse: pass', 'while: pass', 'def f(a.b): pass', 'def (a): pass', 'def f(a:int=1)->str: pass', 'def f(a, (b, c)): pass',
    'lambda (a, b): a', '@a\nx = 1', '@a\n@b\nclass C: pass', 'case x: pass', 'print(a b)', '[a b]',
    'a b', 'a.b c', 'x = {1: 2, 3}', 'x = [1, 2', 'x = 1)', '(x]',
]
TOML = [
    'a = 2020-13-45', 'a.b = 1\na = 2', 'a = 2\na.b = 1', '[a]\n[a]', '[a.b]\n[a]', '[a]\n[a.b]',
    'a.b=1\n[a]', '[a]\nb.c=1\n[a.b]', '[a.b]\nx=1\n[a]\nb.y=2', '[[a]]\n[a]', '[a]\n[[a]]', '[[a]]\n[[a]]\n[a.b]\n[[a]]\n[a.b]',
    '[[a]]\n[a.b]\n[a.b]', 'a = {b=1, b=2}', 'a = {b.c=1, b.d=2}', 'a = {b=1}\na.c = 2', 'a = {b=1}\n[a.c]', 'a=[1,2,]\n',
    'a = [{b=1},{b=1}]', 'a = {b={c=1},d=2}\nb=1', 'a=1979-02-29', 'a=1980-02-29', 'a=2000-02-29', 'a=1900-02-29',
    'a=24:00:00', 'a=23:59:60', 'a=07:32:00.999', 'a=1979-05-27 07:32:00.5Z', 'a=1979-05-27T07:32:00+25:00', 'a=1979-05-27T07:32:00-07:00',
    'a=07:32', "a = '''x\ny'''", 'a = """x\\\n  y"""', 'a = "\\q"', 'a = "\\u00e9"', 'a = "\\ud800"',
    'a = "\\U00110000"', '"a" = 1\na = 2', '"\\u0061" = 1\na = 2', '\'a\' = 1\n"a" = 2', 'a . b = 1\n a.c = 2', 'a = 1 # c',
    '# \x01', "a = '\x01'", 'a=+1_000\nb=1__0', 'a=0x_1', 'a=0xdead_beef', 'a=1.',
    'a=.5', 'a=1e5', 'a=inf\nb=-nan', 'a=True', '= 1', 'a',
    'a = ', '[]', '[a.]', '[a', '[[a]', '[ a . b ]',
    'a = [1\n,2\n# c\n]', 'a = {b=1,}', 'a = {\nb=1}', 'a=1 b=2', '[a] b=1', 'a.b.c=1\na.b.d=2',
    'a.b.c=1\na.b=2', '[a.b.c]\n[a]\nb=1', '[a]\nb=1\n[a.b]', '[[a.b]]\n[a]\nb=1', '[[a.b]]\n[a]\nc=1', 'a=[1]\n[[a]]',
    'a=00', 'a=-0', 'a=1-2', "a='x'y", 'a="x\n"', 'a=0001-01-01',
    'a=0000-01-01', 'x=[[1,2],[3]]', 'x=[[[]]]', 'x = [ [ ] ]', 'x={}', 'x=[{}]',
    'x = [{a=[{b=1}]}]\ny=1', 'a=1\r\nb=2\r\n', 'a=1\rb=2', 'a=2020-01-01t00:00:00z', "3.14 = 'pi'", '1 = 2\n1.2=3',
    'a=1_', '\ta = 1', 'a\n=1', '[a]\n\n[b] # c\nx=1', '[x.y.z.w]\n[x]', 'a=""""x""""',
    "a=''''x''''", 'a="""x""""""', '[a]\nb.c.d=1\n[a.b.c.e]', '[a.b.c]\nz=9\n[a]\nb.c.t=1',
]


def parses(parse, text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            parse(text)
        except (SyntaxError, ValueError):
            return False
    return True


@pytest.mark.parametrize("text", PYTHON)
def test_python_agrees_with_ast(text):
    for t in (text, text + "\n", "def g():\n    " + text.replace("\n", "\n    ") + "\n"):
        assert (first_error("python", t) is None) == parses(ast.parse, t), t


@pytest.mark.parametrize("text", TOML)
def test_toml_agrees_with_tomllib(text):
    assert (first_error("toml", text) is None) == parses(tomllib.loads, text)


def test_mutated_python_and_json_agree_with_their_parsers(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/skill_file.parquet").select("path", "content").where("path LIKE '%.py' OR path LIKE '%.json'").collect()
    rnd, n = random.Random(5), 0
    marks = ["(", ")", "=", ":", ",", "*", "+=", "def ", " in ", "{", "}", "'", "1", "lambda ", "\n", " if ", "[", "]", ".", "not "]
    for r in rows:
        text = (r.content or "").replace("\r\n", "\n")
        if not 20 < len(text) < 3000 or "\0" in text or "\f" in text:
            continue
        language, parse = ("python", ast.parse) if r.path.endswith(".py") else ("json", json.loads)
        for _ in range(6):
            i = rnd.randrange(len(text))
            t = text[:i] + rnd.choice(marks) + text[i + rnd.randrange(3) :]
            assert (first_error(language, t) is None) == parses(parse, t), t
            n += 1
    assert n > 200


@pytest.mark.parametrize("text,valid", [("1 = 2", False), ("a + b = c", False), ("this = 1", False), ("1++", False), ("a ? b : c = 1", True), ("this.x = 1", True), ("'a'.b = 1", True), ("[a, b] = c", True), ("class A { 'a' = 1; 2 = 3 }", True), ("(a)++", True)])
def test_javascript_assignment_targets(text, valid):
    assert (first_error("javascript", text) is None) == valid
