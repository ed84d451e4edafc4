"""Python syntax-tree rules with simple taint tracking: the one detector that needs Python."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame

from siltstone.functions.arrow import map_rows
from siltstone.sources.packages import for_engine

# Names that the rules speak of.
MODULES = {"ctypes", "marshal", "pickle", "shelve", "imp", "code", "codeop"}
FROM_MODULES = {"os": {"system", "popen", "execv", "execve", "spawnl", "spawnv"}, "subprocess": {"call", "run", "Popen", "check_output"}, "importlib": {"import_module"}}
SYSTEM = {"os.system", "os.popen", "os.execv", "os.spawnl", "subprocess.call", "subprocess.run", "subprocess.Popen", "subprocess.check_output"}
LOADS = {"pickle.load", "pickle.loads", "marshal.loads", "yaml.load", "shelve.open"}
SOURCES = {"input", "os.environ.get", "os.getenv"}
DYNAMIC = {"eval", "exec", "compile"}
SENSITIVE = (".ssh", ".aws", "/etc/passwd", "/etc/shadow", ".env")


class Visitor(ast.NodeVisitor):
    """Collects (rule, line, name) in the order of the source; aliases and tainted names belong to the file."""

    def __init__(self) -> None:
        self.found: list[tuple[str, int, str]] = []
        self.alias: dict[str, str] = {}
        self.tainted: set[str] = set()

    def name(self, node: ast.AST) -> str:
        if isinstance(node, ast.Name):
            return self.alias.get(node.id, node.id)
        if isinstance(node, ast.Attribute):
            base = self.name(node.value)
            return f"{base}.{node.attr}" if base else node.attr
        return ""

    def hit(self, rule: str, node: ast.AST, what: str) -> None:
        self.found.append((rule, getattr(node, "lineno", 0), what[:200]))

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.alias[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            if a.name.split(".")[0] in MODULES:
                self.hit("AST_001", node, a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            full = f"{node.module or ''}.{a.name}"
            self.alias[a.asname or a.name] = full
            if (node.module or "").split(".")[0] in MODULES:
                self.hit("AST_001", node, full)
            elif a.name in FROM_MODULES.get(node.module or "", ()):
                self.hit("AST_002", node, full)

    def visit_Assign(self, node: ast.Assign) -> None:
        if isinstance(node.value, ast.Call) and self.name(node.value.func) in SOURCES:
            self.tainted |= {t.id for t in node.targets if isinstance(t, ast.Name)}
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        n = self.name(node.func)
        first = node.args[0] if node.args else None
        text = first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else None
        if n == "getattr" and isinstance(first, ast.Name) and first.id in ("__builtins__", "builtins", "os", "sys"):
            self.hit("AST_010", node, n)
        if n == "__import__":
            self.hit("AST_011", node, n)
        if n == "importlib.import_module" and text is None:
            self.hit("AST_012", node, n)
        if n in DYNAMIC:
            self.hit("AST_020", node, n)
            if isinstance(first, ast.Name) and first.id in self.tainted:
                self.hit("AST_021", node, first.id)
        if n in SYSTEM:
            self.hit("AST_030", node, n)
            if any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords):
                self.hit("AST_031", node, n)
        if n == "open" and text and any(s in text for s in SENSITIVE):
            self.hit("AST_040", node, text)
        if n in LOADS:
            self.hit("AST_050", node, n)
        self.generic_visit(node)

    def visit_Try(self, node: ast.Try) -> None:
        for h in node.handlers:
            if h.type is None and any(isinstance(b, ast.Pass) for b in h.body):
                self.hit("AST_060", h, "except")
        self.generic_visit(node)

    def visit_Lambda(self, node: ast.Lambda) -> None:
        if any(isinstance(x, ast.Call) and self.name(x.func) in DYNAMIC | SYSTEM for x in ast.walk(node.body)):
            self.hit("AST_070", node, "lambda")
        self.generic_visit(node)

    def visit_Expr(self, node: ast.Expr) -> None:
        if isinstance(node.value, ast.Call) and self.name(node.value.func) == "compile":
            self.hit("AST_080", node, "compile")
        self.generic_visit(node)


SEVERITY = {"AST_001": "HIGH", "AST_020": "HIGH", "AST_021": "CRITICAL", "AST_030": "HIGH", "AST_031": "CRITICAL", "AST_040": "CRITICAL", "AST_050": "HIGH", "AST_070": "LOW", "AST_060": "LOW"}


def source_findings(text: str | None) -> list[tuple[str, int, str]]:
    """(rule, line, name) of a Python source; none where it doesn't parse."""
    import warnings

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    v = Visitor()
    try:
        v.visit(tree)
    except RecursionError:
        pass
    return v.found


def _scan():
    def one(file_id, text):
        for rule, line, name in source_findings(text):
            yield file_id, rule, SEVERITY.get(rule, "MEDIUM"), line, name

    return one


def ast_findings(f: DataFrame) -> DataFrame:
    """``file_id, rule_id, severity, line_no, name`` of Python files; null texts and texts that don't parse give none."""
    src = for_engine(f, "ast").where("text IS NOT NULL").select("file_id", "text")
    return map_rows(src, _scan, "file_id long, rule_id string, severity string, line_no int, name string")
