"""Source files to symbols, calls, specs and complexity.

Python is parsed by its own grammar. Other languages are lexed: strings and comments are blanked out in place, so that
lines and columns stay, definitions are found by a pattern a language, and bodies by matching braces (indentation for
GDScript). What needs a type checker is out of reach: calls are resolved by name within the file, else left dynamic.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from codeweft.sources.parsers import EXTENSIONS

LANGUAGE = {ext: name for name, exts in EXTENSIONS.items() for ext in exts}
_NOISE = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`?", re.S)
_HASH = re.compile(r"#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S)
# Patterns of definitions, (symbol type, pattern), and of branches, per language.
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|virtual|async|export|default|readonly|synchronized|open|data|partial|suspend|inline|extern|unsafe|pub(?:\([^)]*\))?|const)\s+)*"
DEFINITIONS = {
    "typescript": [("class", _MODS + r"class\s+(\w+)"), ("interface", _MODS + r"interface\s+(\w+)"), ("function", _MODS + r"function\s*\*?\s*(\w+)"), ("method", r"(?m)^[ \t]+" + _MODS + r"(?:get\s+|set\s+)?(\w+)\s*(?:<[^<>]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::\s*[^{;=]+)?(?=\{)")],
    "go": [("class", r"(?m)^type\s+(\w+)\s+(?:struct|interface)"), ("method", r"(?m)^func\s*\([^)]*\)\s*(\w+)"), ("function", r"(?m)^func\s+(\w+)")],
    "java": [("class", _MODS + r"(?:class|enum|record)\s+(\w+)"), ("interface", _MODS + r"interface\s+(\w+)"), ("function", r"(?m)^[ \t]+" + _MODS + r"[\w<>\[\], ?]+\s+(\w+)\s*\([^()]*\)\s*(?:throws\s+[\w, .]+)?(?=\{)")],
    "c": [("class", r"(?m)^\s*(?:typedef\s+)?(?:struct|enum)\s+(\w+)(?=\s*\{)"), ("function", r"(?m)^[\w*][\w\s*]*?\b(\w+)\s*\([^();]*\)\s*(?=\{)")],
    "cpp": [("class", r"(?:class|struct)\s+(\w+)(?=[^;{]*\{)"), ("module", r"namespace\s+(\w+)"), ("function", r"(?m)^[\w*&:<>~\s]*?\b(~?\w+)\s*\([^();]*\)\s*(?:const\s*)?(?=\{)")],
    "csharp": [("class", _MODS + r"(?:class|struct|record)\s+(\w+)"), ("interface", _MODS + r"interface\s+(\w+)"), ("function", r"(?m)^[ \t]+" + _MODS + r"[\w<>\[\], ?]+\s+(\w+)\s*\([^()]*\)\s*(?=\{)")],
    "kotlin": [("class", _MODS + r"(?:class|object|interface)\s+(\w+)"), ("function", _MODS + r"fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)")],
    "php": [("class", _MODS + r"class\s+(\w+)"), ("interface", r"(?:interface|trait)\s+(\w+)"), ("method", r"(?m)^[ \t]+" + _MODS + r"function\s+(\w+)"), ("function", r"(?m)^function\s+(\w+)")],
    "rust": [("class", r"(?:struct|enum)\s+(\w+)"), ("class", r"\bimpl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)"), ("interface", r"\btrait\s+(\w+)"), ("module", r"\bmod\s+(\w+)(?=\s*\{)"), ("function", r"\bfn\s+(\w+)")],
    "gdscript": [("class", r"(?m)^class(?:_name)?\s+(\w+)"), ("field", r"(?m)^signal\s+(\w+)"), ("function", r"(?m)^[ \t]*(?:static\s+)?func\s+(\w+)")],
}
DEFINITIONS["javascript"] = DEFINITIONS["typescript"]
_LOGICAL = r"|&&|\|\|"
BRANCHES = {
    "typescript": r"\b(?:if|for|while|do|case|catch)\b|\?(?![.?:])|&&|\|\||\?\?", "go": r"\b(?:if|for|case)\b" + _LOGICAL,
    "java": r"\b(?:if|for|while|do|case|catch)\b|\?(?![.?:>])" + _LOGICAL, "c": r"\b(?:if|for|while|case)\b", "cpp": r"\b(?:if|for|while|catch)\b",
    "csharp": r"\b(?:if|for|foreach|while|case|default|catch)\b", "kotlin": r"\b(?:if|for|while|catch)\b", "php": r"\b(?:if|for|foreach|while|catch)\b",
    "rust": r"\b(?:if|for|while|loop)\b|=>" + _LOGICAL, "gdscript": r"\b(?:if|for|while)\b",
}
BRANCHES["javascript"] = BRANCHES["typescript"]
_CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*)\s*\(")
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "fun", "match", "sizeof", "typeof", "new", "super", "constructor", "foreach", "elif", "def", "class", "do", "else", "using", "lock"}
_SPEC = {
    "typescript": (r"\b(?:it|test)(?:\.\w+)*\s*\(\s*(['\"`])(.*?)\1", r"\bexpect\s*\([^\n;]*"),
    "go": (r"(?m)^func\s+()(Test\w+)\s*\(", r"\bt\.(?:Error|Fatal|Errorf|Fatalf)\s*\([^\n]*"),
    "rust": (r"#\[test\]\s*(?:async\s+)?fn\s+()(\w+)", r"\bassert(?:_eq|_ne)?!\s*\([^\n;]*"),
    "java": (r"@Test\b[^;{]*?\bvoid\s+()(\w+)\s*\(", r"\bassert\w*\s*\([^\n;]*"),
}
_SPEC["javascript"] = _SPEC["typescript"]


@dataclass
class Parsed:
    """What a file holds. nodes: (name, type, start, end, signature, visibility, cyclomatic, docstring). edges: (from name,
    to name, type, dynamic, line), the file's own name empty. specs: (name, title, assertions, line)."""

    nodes: list[tuple] = field(default_factory=list)
    edges: list[tuple] = field(default_factory=list)
    specs: list[tuple] = field(default_factory=list)


def _python(text: str) -> Parsed:
    out = Parsed()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out
    branching = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case)

    def complexity(node: ast.AST) -> int:
        n = 1
        for x in ast.walk(node):
            n += isinstance(x, branching)
            n += len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0
        return n

    def asserts(node: ast.AST) -> list[str]:
        found = []
        for x in ast.walk(node):
            if isinstance(x, ast.Assert) or (isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr.startswith("assert")):
                found.append((x.lineno, ast.unparse(x)[:100]))
        return [t for _, t in sorted(found)]

    names: set[str] = set()

    def visit(node: ast.AST, owner: str, in_class: bool) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(x, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                name = f"{owner}.{x.name}" if in_class else x.name
                names.add(x.name)
                sig = None if is_class else f"{x.name}({ast.unparse(x.args)})" + (f" -> {ast.unparse(x.returns)}" if x.returns else "")
                out.nodes.append((name, kind, x.lineno, x.end_lineno, sig, "public", complexity(x), ast.get_docstring(x)))
                out.edges.append((owner if in_class else "", name, "contains" if in_class else "defines", False, x.lineno))
                if is_class:
                    out.edges += [(name, ast.unparse(b), "inherits", False, x.lineno) for b in x.bases]
                if not is_class and x.name.startswith("test_") and (not in_class or re.match(r"Test|.*TestCase$", owner)):
                    out.specs.append((name, x.name, asserts(x), x.lineno))
                visit(x, name, is_class)
            else:
                if isinstance(x, ast.Call):
                    f = x.func
                    called = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if called:
                        out.edges.append((owner, called, "calls", True, x.lineno))
                visit(x, owner, in_class)

    visit(tree, "", False)
    return out


def _blank(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _close(text: str, at: int) -> int:
    """The place after the brace that closes the first one from ``at`` on, or of the line's end if none opens."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(text, at):
        if m.group() == ";" and not depth:
            return m.end()
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if not depth and m.group() == "}":
            return m.end()
    return len(text)


def _lexed(text: str, lang: str) -> Parsed:
    out = Parsed()
    clean = _blank(text, _HASH if lang == "gdscript" else _NOISE)
    starts = [0, *(m.end() for m in re.finditer("\n", clean))]
    line = lambda at: bisect_right(starts, at)
    defs: dict[int, tuple[str, str, int, int]] = {}
    for kind, pattern in DEFINITIONS[lang]:
        for m in re.finditer(pattern, clean):
            name, at = m.group(1), m.start(1)
            if at in defs or name in _NO_CALL:
                continue
            end = _close(clean, m.end())
            if lang == "gdscript":
                lead = re.match(r"[ \t]*", clean[clean.rfind("\n", 0, at) + 1 :]).group()
                stop = re.compile(rf"\n(?![ \t]*\n)(?!{lead}[ \t])(?=\S|[ \t]+\S)").search(clean, at)
                end = stop.start() if stop else len(clean)
            defs[at] = (name, kind, m.start(), end)
    branch = re.compile(BRANCHES[lang])
    order = sorted(defs.items())
    stack: list[tuple[str, str, int]] = []
    spans: list[tuple[int, int, str]] = []
    for at, (name, kind, start, end) in order:
        while stack and stack[-1][2] <= at:
            stack.pop()
        owner = next((s for s in reversed(stack) if s[1] in ("class", "interface")), None)
        full = f"{owner[0]}.{name}" if owner else name
        if lang in ("typescript", "javascript") and kind == "method" and not owner:
            continue
        stop = min(x for x in (text.find("{", at), text.find("\n", at) if lang == "gdscript" else -1, end) if x >= 0)
        head = re.sub(r"\s+", " ", text[start : min(stop, end)]).strip().rstrip(":")
        mods = clean[clean.rfind("\n", 0, at) + 1 : at]
        seen = next((v for v in ("private", "protected", "internal") if re.search(rf"\b{v}\b", mods)), "public") if lang in ("typescript", "javascript") else "public"
        mark = "#" if lang in ("gdscript", "php") else "//"
        before = re.search(rf"(/\*(?:(?!\*/).)*\*/|(?:[ \t]*{mark}[^\n]*\n)+)[ \t]*\n?\Z", text[: clean.rfind("\n", 0, start) + 1], re.S)
        doc = re.sub(r"(?m)^\s*(?:/\*\*?|\*/|\*|///?|#+)\s?|\*/\s*$", "", before.group(1)).strip() if before else None
        out.nodes.append((full, kind, line(start), line(max(start, end - 1)), None if kind in ("class", "interface", "module") else head[:500], seen, 1 + len(branch.findall(clean, at, end)), doc or None))
        out.edges.append((owner[0] if owner else "", full, "contains" if owner else "defines", False, line(at)))
        spans.append((start, end, full))
        stack.append((full, kind, end))
    inner = sorted(spans, key=lambda s: s[0])
    for m in _CALL.finditer(clean):
        if m.group(1) in _NO_CALL or m.start(1) in defs:
            continue
        owner = next((n for s, e, n in reversed([x for x in inner if x[0] <= m.start()]) if m.start() < e), "") if len(inner) < 64 else _innermost(inner, m.start())
        out.edges.append((owner, m.group(1), "calls", True, line(m.start())))
    if lang in _SPEC:
        title, check = _SPEC[lang]
        found = list(re.finditer(title, text))
        for i, m in enumerate(found):
            upto = found[i + 1].start() if i + 1 < len(found) else len(text)
            out.specs.append((m.group(2), m.group(2), [x.group().strip()[:80] for x in re.finditer(check, text[m.end() : upto])], line(m.start())))
    return out


def _innermost(spans: list[tuple[int, int, str]], at: int) -> str:
    i = bisect_right(spans, (at, 1 << 60, "")) - 1
    while i >= 0:
        if at < spans[i][1]:
            return spans[i][2]
        i -= 1
    return ""


def _yaml(text: str) -> Parsed:
    """Top-level keys, jobs and what they use, by indentation; a text with tabs before a key has none."""
    out, job = Parsed(), ""
    lines = text.splitlines()
    if any(re.match(r"^ *\t+\S", x) for x in lines):
        return out
    section = ""
    for i, s in enumerate(lines, 1):
        if m := re.match(r"^([A-Za-z_][\w.-]*)\s*:(?:\s|$)", s):
            section, job = m.group(1), ""
            out.nodes.append((section, "config_key", i, i, None, "public", 0, None))
            out.edges.append(("", section, "contains", False, i))
        elif section == "jobs" and (m := re.match(r"^  ([A-Za-z_][\w-]*)\s*:\s*$", s)):
            job = f"job:{m.group(1)}"
            out.nodes.append((job, "function", i, i, None, "public", 0, None))
            out.edges.append(("", job, "contains", False, i))
        elif job and (m := re.match(r"^\s+(?:-\s+)?uses\s*:\s*['\"]?([^'\"\s#]+)", s)):
            out.edges.append((job, m.group(1), "calls", False, i))
    return out


#: Parsers of further languages by extension; a registered one comes before the built-in ones.
PLUGINS: dict[str, Callable[[str], Parsed]] = {}


def register(extension: str, parser: Callable[[str], Parsed]) -> None:
    PLUGINS[extension.lower().lstrip(".")] = parser


def parse(path: str | None, text: str | None, plugins: dict[str, Callable[[str], Parsed]] | None = None) -> Parsed:
    """What a file holds; calls of a name that the file defines are resolved to it, others stay bare and dynamic.

    Null paths and texts and files of no known kind hold nothing.
    """
    ext = (path or "").lower().rsplit(".", 1)[-1]
    plugins = PLUGINS if plugins is None else plugins
    if not text:
        return Parsed()
    if ext in plugins:
        out = plugins[ext](text)
    elif ext == "py":
        out = _python(text)
    elif ext in LANGUAGE:
        out = _lexed(text, LANGUAGE[ext])
    elif ext in ("yml", "yaml"):
        out = _yaml(text)
    else:
        return Parsed()
    known: dict[str, str] = {}
    for n in out.nodes:
        known.setdefault(n[0].rsplit(".", 1)[-1], n[0])
    out.edges = [(a, known[b], t, False, ln) if t == "calls" and dyn and b in known else (a, b, t, dyn, ln) for a, b, t, dyn, ln in out.edges]
    return out


_NODES = "path string, name string, symbol_type string, start_line int, end_line int, signature string, visibility string, cyclomatic int, docstring string"
_EDGES = "path string, from_name string, to_name string, edge_type string, dynamic boolean, call_site_line int"
_SPECS = "path string, name string, title string, assertions array<string>, start_line int"


def _table(files: DataFrame, part: str, schema: str) -> DataFrame:
    plugins = dict(PLUGINS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *x) for p, t in zip(pdf.path, pdf.text) for x in getattr(parse(p, t, plugins), part)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return files.select("path", "text").filter("path is not null and text is not null").mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, symbol_type, start_line, end_line, signature, visibility, cyclomatic, docstring) of files (path, text)."""
    return _table(files, "nodes", _NODES)


def relations(files: DataFrame) -> DataFrame:
    """(path, from_name, to_name, edge_type, dynamic, call_site_line); an empty from_name is the file itself."""
    return _table(files, "edges", _EDGES)


def specs(files: DataFrame) -> DataFrame:
    """(path, name, title, assertions, start_line) of the tests in files."""
    return _table(files, "specs", _SPECS)
