"""Functions paired with their documentation.

``extract`` lexes source text with a state machine over one table of comment marks, string forms and block rules per
language family, matches braces (or indentation, or ``end``) to delimit functions, and attaches the documentation
comment that stands immediately before a function, or the string that opens its body. ``says_something`` then drops
documentation that is empty or trivial; what of it is leftover code is told by lexing each line into a statement's shape.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- lexing ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Syntax:
    """How a family of languages writes comments, strings and bodies.

    line: marks of comments to the line's end. block: whether /* */ comments. directive: whether a line that starts with
    # is for the preprocessor. chars: single quotes hold one character. body: what delimits a function's body.
    """

    line: tuple[str, ...] = ("//",)
    block: bool = True
    directive: bool = False
    chars: bool = False
    ticks: bool = False
    triple: bool = False
    body: str = "brace"


SYNTAX = {
    "c": Syntax(directive=True, chars=True),
    "java": Syntax(chars=True, triple=True, directive=True),
    "go": Syntax(chars=True, ticks=True),
    "rust": Syntax(chars=True),
    "script": Syntax(ticks=True),
    "php": Syntax(line=("//", "#(?!\\[)")),
    "hash": Syntax(line=("(?<![\\w$&{])#",), block=False),
    "python": Syntax(line=("#",), block=False, triple=True, body="indent"),
    "ruby": Syntax(line=("(?<![\\w$&{])#(?!\\{)",), block=False, body="end"),
    "lua": Syntax(line=("--",), block=False, body="end"),
}
# Endings of file names by family.
_FAMILY = {e: k for k, v in {
    "c": "c h cc cpp cxx hpp hh m mm", "java": "java kt kts scala cs swift groovy dart", "go": "go", "rust": "rs", "script": "js jsx mjs cjs ts tsx vue",
    "php": "php", "hash": "pl pm sh bash zsh r", "python": "py pyi gd", "ruby": "rb ex exs", "lua": "lua",
}.items() for e in v.split()}
#: What tells a family by its text, the first that is found.
_SIGNS = [
    ("php", re.compile(r"<\?php")),
    ("python", re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+\w+[ \t]*\((?:[^\n]*:[ \t]*(?:\#[^\n]*)?$|[^\n]*,[ \t]*$)|^[ \t]*class[ \t]+\w+[^\n{]*:[ \t]*$|^[ \t]*func[ \t]+\w+\([^\n]*:[ \t]*$", re.M)),
    ("ruby", re.compile(r"^[ \t]*def[ \t]+[\w.]+[?!=]?[^\n{]*$(?=.*^[ \t]*end\b)", re.M | re.S)),
    ("lua", re.compile(r"\bfunction\b[^\n{]*$(?=.*^[ \t]*end\b)", re.M | re.S)),
    ("rust", re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+|unsafe[ \t]+|const[ \t]+)*fn[ \t]+\w+", re.M)),
    ("go", re.compile(r"^func[ \t]+(?:\(|\w+\()|^package[ \t]+\w+$", re.M)),
    ("hash", re.compile(r"^[ \t]*sub[ \t]+\w+|\A#!.*\b(?:ba|z)?sh\b|^\w+\(\)[ \t]*\{", re.M)),
    ("c", re.compile(r"^[ \t]*#[ \t]*(?:include|define|undef|ifn?def|if|endif|pragma)\b", re.M)),
    ("java", re.compile(r"^[ \t]*(?:public|private|protected|internal|static|namespace|using|fun|override)\b[^\n]*$", re.M)),
    ("hash", re.compile(r"\A(?![^\n]*//)(?:[ \t]*#[^\n]*\n)+(?!.*(?://|/\*|^[ \t]*\#))", re.M | re.S)),
]


_BRACED = re.compile(r"[{;][ \t\r]*$", re.M)


def family_of(text: str, path: str | None = None) -> str:
    """The family of a source text: by what stands in it, else by its file name's ending, else the one of scripts."""
    for name, sign in _SIGNS:
        if sign.search(text):
            return name
    named = _FAMILY.get((path or "").rpartition(".")[2].lower(), "script")
    return "script" if SYNTAX[named].body != "brace" and _BRACED.search(text) else named


def _machine(s: Syntax) -> re.Pattern:
    """Comments, directives, strings, brackets and line ends: what lies between is plain code. Unclosed ones run to the end."""
    comments = [*([r"/\*.*?(?:\*/|\Z)"] if s.block else []), *([r"--\[\[.*?(?:\]\]|\Z)"] if "--" in s.line else []), *[m + r"[^\n]*" for m in s.line]]
    if s.body == "end" and "--" not in s.line:
        comments.append(r"^=begin\b.*?(?:^=end[^\n]*|\Z)")
    parts = []
    if s.directive:
        parts.append(r"(?P<directive>^[ \t]*\#(?!\[)[^\n]*(?:(?<=\\)\n[^\n]*)*)")
    parts.append("(?P<comment>" + "|".join(comments) + ")")
    if s.triple:
        parts.append(r"(?P<triple>[rRbBuUfF]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)))" if s.body == "indent" else r"(?P<triple>\"\"\".*?(?:\"\"\"|\Z))")
    single = r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'" if s.chars else r"'(?:[^'\\\n]|\\.)*'"
    ticks = r"|`(?:[^`\\]|\\.)*(?:`|\Z)" if s.ticks else ""
    parts.append(rf"(?P<string>\"(?:[^\"\\\n]|\\.)*(?:\"|(?=\n)|\Z)|{single}{ticks})")
    parts.append(r"(?P<open>[({\[])|(?P<close>[)}\]])|(?P<end>;)|(?P<line>\n)")
    return re.compile("|".join(parts), re.S | re.M)


_MACHINES = {k: _machine(v) for k, v in SYNTAX.items()}
#: A head of a function: a keyword that opens one, a name that a function is given to, or a name with parameters.
_KEYWORD = re.compile(r"\b(?:def|func|fn|fun|function|sub)\b\s*(?:\([^()]*\)\s*)?\*?\s*(?:[\w$]+[.:])*(?P<name>[\w$]+[?!=]?(?![\w$]))?")
_GIVEN = re.compile(r"(?P<name>[\w$]+)\s*(?::[^=]*(?:=>[^=]*)?)?=\s*(?:async\s*)?(?:function\b|(?:<[^<>]*>\s*)?(?:\((?P<in>.*)\)|[\w$]+)\s*(?::.*)?=>)", re.S)
_CALLABLE = re.compile(r"(?P<name>[\w$~]+)\s*(?:<[^<>()]*>)?\s*\(")
_CONTROL = {"if", "for", "foreach", "while", "switch", "catch", "match", "return", "else", "do", "with", "elif", "new", "throw", "using", "lock", "synchronized", "sizeof", "await", "yield", "in", "and", "or", "not", "unless", "until", "case"}
_OPENERS = re.compile(r"^(?:(?:local\s+|async\s+|private\s+|public\s+)?(?:def|function|class|module|if|unless|while|until|case|begin|for|repeat)\b|do\b)|\bdo\s*(?:\|[^|]*\|)?$|=\s*function\b|\bthen$")
_CLOSERS = re.compile(r"^(?:end|until)\b")


@dataclass
class Function:
    """A function found in a source text: its head as written, name, documentation as written, and place."""

    name: str
    signature: str
    doc: str
    start: int
    end: int


def _head(code: str) -> str | None:
    """The name of the function that ``code``, up to its body, is the head of."""
    m = _GIVEN.search(code) if "=" in code else None
    if m:
        return m["name"]
    m = _KEYWORD.search(code)
    if m and m["name"]:
        return m["name"]
    m = _CALLABLE.search(code)
    if not m or m["name"] in _CONTROL or "=" in code[: m.start()]:
        return None
    return None if set(re.findall(r"[A-Za-z_]+", code[: m.start()])) & _CONTROL else m["name"]


#: Signs after which a statement goes on, and what may come before a body on the lines after a head.
_ON = tuple(",({[=+-*/&|.:>")
_NEXT = re.compile(r"\s*(?:\{|where\b|throws\b|:|->|=>|const\b|noexcept\b|override\b|//|/\*)")


class _Reader:
    """The state machine: brackets nest, a body opens after a head by its family's rule, and a comment block is held until
    code other than a decorator, or a blank line, parts it from the next head."""

    def __init__(self, source: str, family: str):
        self.source, self.rule = source, SYNTAX[family].body
        self.found: list[Function] = []
        self.open: list[tuple[str, Function | None]] = []  # bracket or "end", and the function whose body it opens
        self.inside = 0  # brackets that aren't bodies
        self.indented: list[tuple[int, Function]] = []  # bodies delimited by indentation
        self.held: list[str] = []  # documentation waiting for a head
        self.begin: int | None = None  # where the statement's code starts
        self.code, self.fresh = "", None  # fresh: a function whose body may open with its documentation
        last = 0
        for m in _MACHINES[family].finditer(source):
            self.feed(source[last : m.start()], last)
            last = m.end()
            getattr(self, "on_" + m.lastgroup)(m)
        self.feed(source[last:], last)
        self.finish(len(source))

    def feed(self, text: str, at: int) -> None:
        if not text or (self.begin is None and text.isspace()):
            return
        if self.begin is None:
            self.begin = at + len(text) - len(text.lstrip())
            column = self.column(self.begin)
            while self.indented and column <= self.indented[-1][0] and not self.inside:
                self.indented.pop()[1].end = at
            self.fresh = None
        self.code += text

    def column(self, at: int) -> int:
        return at - self.source.rfind("\n", 0, at) - 1

    def function(self, end: int) -> Function | None:
        name = _head(self.code)
        if name is None or self.begin is None:
            return None
        f = Function(name, self.source[self.begin : end].strip(), "\n".join(self.held), self.begin, len(self.source))
        self.found.append(f)
        return f

    def reset(self, drop: bool = True) -> None:
        self.begin, self.code = None, ""
        if drop:
            self.held.clear()

    def on_comment(self, m: re.Match) -> None:
        at = m.start()
        if self.begin is None and (self.held or m.group().startswith("/*") or not self.source[self.source.rfind("\n", 0, at) + 1 : at].strip()):
            self.held.append(m.group())  # a remark behind code on its line belongs to that code

    def on_directive(self, m: re.Match) -> None:
        if not self.inside:
            self.reset()

    def on_triple(self, m: re.Match) -> None:
        if self.rule != "indent" or self.begin is not None or self.inside:
            self.feed('""', m.start())
        elif self.fresh is not None:
            self.fresh.doc = self.fresh.doc + "\n" + m.group() if self.fresh.doc else m.group()
            self.fresh = None
        else:
            self.held.clear()  # a text of its own, such as a module's or class's documentation

    def on_string(self, m: re.Match) -> None:
        if self.rule == "indent" and self.begin is None and self.fresh is not None:
            self.on_triple(m)
        else:
            self.feed('""', m.start())

    def on_open(self, m: re.Match) -> None:
        text = m.group()
        tail = self.code.rstrip()[-1:]
        if text == "{" and self.rule == "brace" and not self.inside and not (tail and tail in "<|&:," and self.begin is not None):
            f = self.function(m.start())
            self.open.append((text, f))
            self.reset()
            self.fresh = f
        else:
            self.feed(text, m.start())
            self.open.append(("{type" if text == "{" else text, None))
            self.inside += 1

    def on_close(self, m: re.Match) -> None:
        text, body = m.group(), False
        while self.open and self.open[-1][0] != "end":
            b, f = self.open.pop()
            body = b == "{"
            self.inside -= not body
            if f:
                f.end = m.end()
            if {"(": ")", "{": "}", "[": "]"}[b[0]] == text:
                break
        if text == "}" and body and not self.inside:
            self.reset()
        else:
            self.feed(text, m.start())

    def on_end(self, m: re.Match) -> None:
        if not self.inside:
            self.given(m.start())
            self.reset()

    def given(self, end: int) -> None:
        """A function with an expression for a body: its head ends at the arrow."""
        if self.rule == "brace" and "=>" in self.code and _GIVEN.search(self.code):
            arrow = self.source.rfind("=>", self.begin, end)
            f = self.function(arrow)
            if f:
                f.end = end

    def on_line(self, m: re.Match) -> None:
        if self.inside:
            self.feed(" ", m.start())
            return
        if self.rule == "brace" and self.code[-1:] in _ON:
            self.code += "\n"  # a statement that goes on
            return
        code = self.code.strip()
        if not code:
            if self.held and self.source[m.end() : m.end() + 1] in ("\n", "\r"):
                self.held.clear()  # a blank line parts a comment from what follows
        elif self.rule == "end":
            self.ended(code, m.start())
        elif self.rule == "indent":
            self.indent(code, m.start())
        elif code.startswith(("@", "#[")) and not _head(code.partition("\n")[2] or "") or re.match(r"\[[^\]]*\]$", code):
            self.reset(drop=False)
        elif code[-1] in _ON or (_NEXT.match(self.source, m.end()) and _head(code)):
            self.code += "\n"
        else:
            self.reset()

    def indent(self, code: str, end: int) -> None:
        if code.startswith("@"):
            self.reset(drop=False)
        elif code.endswith("\\"):
            self.code += "\n"
        else:
            f = self.function(end) if code.endswith(":") and _KEYWORD.match(code.removeprefix("async").lstrip()) else None
            if f:
                self.indented.append((self.column(f.start), f))
                f.signature = f.signature.rstrip(": \t")
            self.reset()
            self.fresh = f

    def ended(self, code: str, end: int) -> None:
        if _CLOSERS.match(code):
            while self.open:
                kind, f = self.open.pop()
                if f:
                    f.end = end
                if kind == "end":
                    break
            self.reset()
        elif _OPENERS.search(code) and not re.search(r"\bend$", code):
            own = re.match(r"(?:(?:local|async|private|public)\s+)?(?:def|function)\b", code) or re.search(r"=\s*function\b", code)
            self.open.append(("end", self.function(end) if own else None))
            self.reset()
        else:
            self.reset()

    def finish(self, end: int) -> None:
        if self.begin is None or self.inside:
            return
        code = self.code.strip()
        if self.rule == "indent":
            self.indent(code, end)
        elif self.rule == "brace":
            self.given(end)


def extract(source: str | None, path: str | None = None, family: str | None = None) -> list[Function]:
    """The functions of a source text in order, nested ones too. Null, empty and unlexable texts have none.

    ``family`` names the language's row of ``SYNTAX``; without it the text, else its ``path``, tells it.
    """
    if not source:
        return []
    return _Reader(source, family or family_of(source, path)).found


_KINDS = {w: k for k, v in {
    "r": "return throw raise yield await delete", "i": "if for while switch foreach elif catch", "e": "else try finally do", "d": "const let var val final auto int string bool double",
    "m": "import from using include package", "f": "def fn func function", "b": "break continue pass", "n": "new", "p": "print printf println console log logger logging",
}.items() for w in v.split()}
_PIECE = re.compile(r"(?P<word>[^\W\d][\w$]*)|(?P<number>\d[\w.]*)|(?P<link>\.(?=\w)|::|->(?=\w)|\?\.)|(?P<set>(?:[-+*/|&%^]|<<|>>|\?\?)?=(?![=>]))|(?P<arrow>=>)|(?P<space>\s+)|(?P<sign>.)", re.S)
#: Shapes of statements: calls, assignments, declarations, control heads, brackets alone, imports, jumps.
_STATEMENT = re.compile(
    r"r.*|i[P({].*|e\{?|d ?w.*[=;].*|[wdnp](?:[.:]?[w]|[PBo.:>-])*=[^=].*|(?:[rn] )?[wp](?:\.\w|[:>-]w)*(?:\.?P)+(?:\{|;|-?>.*)?|[PBC{}()\[\],;]+|m [ws<.\"'/]+;?|p(?:\.w)*[^ ]*[P(].*|.*;|.*\{|f w[P(].*|b"
)


def shape(text: str) -> str:
    """One letter a token of a line, strings and closed brackets as one token each: what the lexer makes of it as code."""
    out: list[str] = []
    last, depth = 0, []

    def feed(piece: str) -> None:
        for m in _PIECE.finditer(piece):
            kind, t = m.lastgroup, m.group()
            out.append({"word": lambda: _KINDS.get(t, "w"), "number": lambda: "w", "link": lambda: ".", "set": lambda: "=", "arrow": lambda: ">", "space": lambda: " ", "sign": lambda: t}[kind]())

    for m in _MACHINES["script"].finditer(text):
        feed(text[last : m.start()])
        last, kind, t = m.end(), m.lastgroup, m.group()
        if kind == "string":
            out.append("s")
        elif kind == "open":
            depth.append((t, len(out)))
            out.append(t)
        elif kind == "close":
            if depth and {"(": ")", "{": "}", "[": "]"}[depth[-1][0]] == t:
                start = depth.pop()[1]
                inner = out[start + 1 :]
                if t == "}" and not any(x != " " for x in inner) and start == 0:
                    del out[start:]
                    out += ["{", "}"]
                else:
                    del out[start:]
                    out.append({")": "P", "]": "B", "}": "C"}[t])
            else:
                out.append(t)
        elif kind == "end":
            out.append(";")
        elif kind == "line":
            out.append(" ")
    feed(text[last:])
    flat = re.sub(r" *([^\w ]|[PBC]) *", r"\1", "".join(out).strip())
    return flat


_SENTENCE = re.compile(r"[.!?…。]\s*$")


def is_code(line: str) -> bool:
    """Whether a line of text lexes as a statement; a line that ends as a sentence does is none."""
    return not _SENTENCE.search(line) and bool(_STATEMENT.fullmatch(shape(line)))


# -- judging -----------------------------------------------------------------------------------------------------------

_FRAME = re.compile(r"^\s*(?:/\*+!?|\*+/|///?!?<?|\*(?!\w)|#+!?(?!region|endregion|pragma|\w)|--+(?=\s)|;+(?=\s)|[rRbBuUfF]{0,2}(?:\"\"\"|''')|<!--)+[ \t]?")
_TAIL = re.compile(r"\s*(?:\*+/|\"\"\"|'''|-->)\s*$")
_RULER = re.compile(r"^[\W_]*$")
_REGION = re.compile(r"^#?\s*(?:end)?region\b.*$|^#\s*pragma\b.*$|^#!.*$", re.I)
# The marks by which tools are addressed in comments.
_TOOL = re.compile(
    r"^(?:[@#]?\s*)(?:eslint(?:-\w+)*|tslint|jshint|jslint|stylelint\S*|prettier-ignore\S*|nolint\S*|noinspection|noqa|type:\s*ignore|"
    r"pylint|flake8|mypy|pyright|ruff|isort|yapf|fmt|rustfmt\S*|clang-\w+|clang-format|ts-(?:ignore|expect-error|nocheck)|"
    r"istanbul|c8 ignore|v8 ignore|pragma|coverage|nosec|nosonar|sonar\S*|go:\w+|\+build|checkstyle|spotbugs|suppress\S*|"
    r"rubocop|biome-ignore|deno-\w+|webpack\w+|vim|checkov|gitleaks|codespell|cspell|detekt|ktlint\S*|swiftlint|phpcs|phpstan\S*|psalm\S*|"
    r"resharper|stylecop)\b[\s:\-,=\w./@()\[\]]*$",
    re.I,
)
_TAGS = re.compile(r"^[@\\:](?P<tag>[A-Za-z][\w-]*)\b:?(?P<rest>.*)$", re.S)
_NAMED = {"param", "parameter", "arg", "argument", "type", "property", "prop", "template", "typeparam", "keyword", "raises", "throws", "exception", "var", "ivar", "cvar"}
_RESULT = {"return", "returns", "rtype", "yields", "yield"}
_MUTE = {"inheritdoc", "override", "see", "author", "since", "version", "date", "internal", "private", "public", "protected", "static", "async", "abstract", "readonly", "suppress", "suppresswarnings", "nullable", "test", "memberof", "function", "method", "class", "name", "link", "hidden", "ignore", "api", "access", "package", "module", "export", "final", "generated"}
_SECTION = re.compile(r"^(?:args?|arguments|parameters|params|returns?|raises|throws|yields|examples?|attributes|notes?)\s*:?\s*$", re.I)
_ITEM = re.compile(r"^[`*]*(?P<name>[\w$.]+)[`*]*\s*(?:\([^()]*\))?\s*(?:::?|\s-)\s*(?P<rest>.*)$")
# Phrases that stand where documentation is still missing.
_PLACEHOLDER = re.compile(
    r"^(?:(?:todo|fixme|xxx|tbd|hack|tba|wip)\b[\s:.\-()!]*)*(?:(?:please\s+)?(?:add|write|insert|fill\s+in|provide|put|missing|needs?|no|update|improve|generate)?\s*(?:the\s+|a\s+|some\s+|your\s+|any\s+)?"
    r"(?:method|function|class|code)?\s*(?:documentation|docs?|docstrings?|description|comments?|summary|javadoc|jsdoc|details?)?\s*(?:goes|comes|belongs|required|needed|missing|available|yet|provided|given)?\s*(?:in|to\s+be\s+added|here|later|pending)?|"
    r"document(?:\s+(?:this|me|it|that))?(?:\s+(?:function|method|later))?|undocumented|not\s+documented(?:\s+yet)?|to\s+be\s+(?:done|documented|defined|written|added)|"
    r"(?:auto[\s-]*generated|automatically\s+generated|generated)\s+(?:method|function|constructor|catch|class|code)?\s*(?:stub|block|body|comment)?|"
    r"(?:method|function|constructor)?\s*stub|n\s*/?\s*a|none|null|nil|empty|placeholder|dummy|lorem\s+ipsum.*|blah(?:\s+blah)*|foo|bar|implement(?:\s+(?:me|this))?(?:\s+later)?|"
    r"not\s+(?:yet\s+)?implemented(?:\s+yet)?|same\s+as\s+above|see\s+above|self[\s-]*explanatory)[\s.!…]*$",
    re.I,
)
#: Words that add nothing to a name: articles, helpers, kinds of symbols and the verbs that only introduce them.
_EMPTY_WORDS = {"the", "a", "an", "this", "that", "is", "are", "it", "of", "to", "for", "in", "on", "and", "or", "with", "by", "function", "method", "procedure", "constructor", "class", "member", "helper", "routine", "func", "def", "fn", "fun", "void", "self", "name", "named", "called", "value", "values", "param", "parameter", "parameters", "argument", "arguments", "return", "returns", "returned", "result", "public", "private", "static", "async"}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+|\d+")


def plain(doc: str) -> list[str]:
    """The lines of a documentation comment without comment marks, rulers, notes to tools and regions."""
    lines = []
    for line in doc.splitlines():
        if _REGION.match(line.strip()):
            continue
        s = line
        while True:
            t = _TAIL.sub("", _FRAME.sub("", s, count=1))
            if t == s:
                break
            s = t
        s = s.strip()
        if not s or _RULER.match(s) or _REGION.match(s) or _TOOL.match(s):
            lines.append("")
        else:
            lines.append(s)
    return lines


def _untagged(text: str) -> str:
    """Markup removed: elements keep what they hold, inline tags what they describe."""
    text = re.sub(r"\{@inheritdoc[^}]*\}", " ", text, flags=re.I)
    text = re.sub(r"\{@(?:link|linkplain|see)\s+[^}]*\}", " ", text, flags=re.I)
    text = re.sub(r"\{@\w+\s*([^}]*)\}", r"\1", text)
    text = re.sub(r"<(?:see|seealso|inheritdoc|paramref)\b[^<>]*/?>", " ", text, flags=re.I)
    return re.sub(r"</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>", " ", text)


def _remains(line: str, args: bool) -> str:
    """What a line describes, its tag, type and parameter name taken off."""
    m = _TAGS.match(line)
    if m:
        tag, rest = m["tag"].lower(), m["rest"].strip()
        if tag in _MUTE:
            return ""
        rest = re.sub(r"^\{(?:[^{}]|\{[^{}]*\})*\}\s*", "", rest)
        if tag in _NAMED:
            rest = re.sub(r"^\[?[\w$.<>\[\],?=]+\]?\s*:?\s*(?:-\s*)?", "", rest)
        elif tag in _RESULT:
            rest = rest.lstrip(":- ")
        return rest
    if _SECTION.match(line):
        return ""
    if args and (m := _ITEM.match(line)):
        return m["rest"]
    return line


def _roots(text: str) -> set[str]:
    """Name parts in lower case, in their own form and without the common endings of verbs and plurals."""
    out = set()
    for w in _PART.findall(text):
        w = w.lower()
        out.add(w)
        for end in ("ies", "es", "s", "ing", "ed", "d", "e"):
            if w.endswith(end) and len(w) - len(end) >= 2:
                stem = w[: -len(end)]
                out |= {stem, stem + "y"} if end == "ies" else {stem}
                if len(stem) > 3 and stem[-1] == stem[-2]:
                    out.add(stem[:-1])
    return out


def says_something(doc: str | None, name: str | None, signature: str | None) -> bool:
    """Whether documentation tells something that name and signature don't already say, in any language.

    Comment marks, rulers, tags without a description, placeholders, stubs, notes to tools, leftover code and the name or
    signature said again tell nothing. Null and blank documentation tells nothing.
    """
    if not doc or not doc.strip():
        return False
    known = _roots(f"{name or ''} {signature or ''}")
    said, args = [], False
    for line in _untagged("\n".join(plain(doc))).splitlines():
        line = line.strip()
        if _SECTION.match(line):
            args = line[:1].lower() in "apr"
        if not line or _RULER.match(line) or _TOOL.match(line):
            continue
        rest = _remains(line, args).strip()
        if not rest or _RULER.match(rest) or _PLACEHOLDER.match(rest):
            continue
        if is_code(rest):
            continue
        said.append(rest)
    words = [w for w in _WORD.findall(" ".join(said))]
    for w in words:
        if w.isdigit():
            continue
        low = w.lower()
        if low in _EMPTY_WORDS or low in known:
            continue
        parts = _roots(w)
        own = [p.lower() for p in _PART.findall(w)]
        if all(p in known or p in _EMPTY_WORDS or _roots(p) & known for p in own) and parts:
            continue
        return True
    return False


# -- DataFrames --------------------------------------------------------------------------------------------------------


def source_of(signature: str, doc: str) -> tuple[str, str]:
    """A node's source and its family, as a file would hold it: the documentation, made a comment if it is bare, and the
    head with a body.

    The documentation's own marks and the head tell the family. A comment's end inside a bare text is written apart, so
    that the text stays one comment. A head without parameters gets empty ones, a cut one its closing brackets.
    """
    head = re.sub(r"[\s{:;]+$", "", signature.strip())
    head += "".join(b * max(0, head.count(a) - head.count(b)) for a, b in ("[]", "()"))
    if not _head(head):
        head += "()"
    s = doc.strip()
    if re.match(r"[rRbBuUfF]{0,2}(\"\"\"|''')", s) or (s.startswith("#") and re.match(r"(?:async\s+)?def\b", head)):
        head = head if re.match(r"(?:async\s+)?def\b", head) else "def " + head
        return (f"{s}\n{head}:\n    pass\n" if s.startswith("#") else f"{head}:\n    {s}\n    pass\n"), "python"
    if s.startswith("#"):
        return f"{s}\n{head} {{\n}}\n", "hash"
    if all(x.lstrip().startswith("--") for x in s.splitlines()):
        return f"{s}\nfunction {head}\nend\n", "lua"
    if not re.match(r"/\*|//", s):
        s = "/**\n" + "\n".join(" * " + x for x in s.replace("*/", "* /").splitlines()) + "\n */"
    return f"{s}\n{head} {{\n}}\n", "script"


def _judged(signature: str | None, doc: str | None, name: str | None) -> bool:
    if not signature or not signature.strip() or not doc or not doc.strip():
        return False
    source, family = source_of(signature, doc)
    pairs = extract(source, family=family)
    return bool(pairs) and says_something(pairs[-1].doc, name, signature)


def documented(nodes: DataFrame) -> DataFrame:
    """(id, signature, docstring) of nodes (id, symbol_name, signature, docstring) whose documentation says something.

    Nodes without a signature or a documentation, null or blank, are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("signature", "docstring", "symbol_name")]
            yield b.select(["id", "signature", "docstring"]).filter(pa.array([_judged(*x) for x in zip(*cols)], pa.bool_()))

    own = nodes.select("id", "symbol_name", "signature", "docstring").filter("signature is not null and docstring is not null")
    return own.mapInArrow(run, "id long, signature string, docstring string")


def source_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id, place, name, signature, docstring) of the documented functions in source texts, numbered from 0 by place.

    Any text is lexed, by the family that it, or else its ``path`` if there is such a column, tells; what has no functions
    gives no rows.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, text, path in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "path")]):
                pairs = (f for f in extract(text, path) if f.doc and says_something(f.doc, f.name, f.signature))
                out += [(key, i, f.name, f.signature, "\n".join(x for x in plain(f.doc) if x)) for i, f in enumerate(pairs)]
            cols = list(zip(*out)) if out else [[]] * 5
            types = [b.schema.field("doc_id").type, pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "place", "name", "signature", "docstring"])

    path = F.col("path").cast("string") if "path" in documents.columns else F.lit(None).cast("string")
    # A body opens by a brace, a colon, an arrow or a keyword: a text with none of them has no functions.
    own = documents.select("doc_id", "text", path.alias("path")).filter(F.col("text").rlike(r"[{:]|=>|\bdef\b|\bfunction\b"))
    return own.mapInArrow(run, f"doc_id {kind}, place int, name string, signature string, docstring string")
