import pytest

from codeweft.llm.docpairs import documented, extract, is_code, plain, says_something, source_of, source_pairs

NAME, SIG = "closeFilePath", "closeFilePath(node: Edge, depth: int): Result"


@pytest.mark.parametrize(
    "doc",
    [
        None, "", "  ", "/** */", "//", "#", "* ", '"""   """', "-----", "~~~~ ====", "* * * * *", "closeFilePath", "/// closeFilePath()", "The closeFilePath function.", "Method closeFilePath",
        "Closes the file path.", "close file paths", "Function close path.", SIG, "TODO", "todo: document this", "FIXME", "XXX", "tbd.", "N/A", "none", "...", "No description.", "Missing docs", "Add documentation here.",
        "Description goes here", "undocumented", "Auto-generated method stub", "TODO Auto-generated method stub", "@inheritdoc", "{@inheritDoc}", "@override", "@see closeFilePath", "<inheritdoc/>", "<summary></summary>",
        "@param node", "@param {Edge} node\n@returns", "@param value @returns".replace(" @", "\n@"), ":param node:\n:return:", "Args:\n    node:", '<param name="node"></param>', "// eslint-disable-line", "eslint-disable-next-line",
        "nolint", "# noqa", "# type: ignore", "@ts-ignore", "pylint: disable=invalid-name", "// prettier-ignore", "#pragma warning disable", "#region helpers", "return self.path", "const x = closeFile(y);", "if (a) {", "Applies",
    ],
)
def test_tells_nothing(doc):
    assert not says_something(doc, "applyFile" if doc == "Applies" else NAME, SIG)


@pytest.mark.parametrize(
    "doc",
    [
        "Never blocks.", "Ascii only.", "Returns -1 when empty.", "/** Not safe across threads. */", "Caller holds the lock.", "Nur für Tests gedacht.", "Ne modifie pas son argument.", "빈 목록이면 바로 끝납니다.",
        "@param node the edge that was hidden before", "@returns the rows in arrival order", "Args:\n    node: what the walk starts from", "/// <summary>\n/// Runs once per commit.\n/// </summary>",
        "# -----\n# Waits until the cache is warm.\n# -----", "TODO: split this too. It was not clear whether the queue should wait.", "closeFilePath skips the hidden rows and keeps their order.", '"""Slow on deep trees."""',
        "The old code used to block every anchor; now it will compare every symbol.", "@deprecated use openStream instead", "変更しない。",
    ],
)
def test_tells_something(doc):
    assert says_something(doc, NAME, SIG)


def test_extraction_knows_strings_and_comments():
    text = """
// not a doc: a blank line follows

/** Adds "}" to s. */
export function add(s: string): string {
    const t = "} // not a comment";  /* { */
    return s + '}' + t;
}

// Counts.
// Twice.
func (s *Store) Count(n int) int {
    if n > 1 { return n }
    return 0
}
fn bare() { }
"""
    got = [(f.name, f.signature, [x for x in plain(f.doc) if x], text[f.start : f.end].rstrip()[-1:]) for f in extract(text)]
    assert [g[0] for g in got] == ["add", "Count", "bare"]
    assert got[0][2] == ['Adds "}" to s.'] and got[1][2] == ["Counts.", "Twice."] and got[2][2] == [] and all(g[3] == "}" for g in got)
    assert got[1][1] == "func (s *Store) Count(n int) int"


def test_extraction_of_indented_bodies():
    text = 'class A:\n    """A class."""\n\n    def f(self,\n          x):\n        """Keeps x: (a "b").\n        """\n        return {"}": 1}\n\n# For all.\ndef g(y): \n    pass\n\nx = g(1)\n'
    got = {f.name: (f.signature, " ".join(x for x in plain(f.doc) if x)) for f in extract(text)}
    assert got["f"][1] == 'Keeps x: (a "b").' and got["g"][1] == "For all." and got["g"][0] == "def g(y)"


@pytest.mark.parametrize("text", [None, "", "{{{{", "}}}}", '"', "/*", "'''", "def", "a" * 200_000, "(" * 5000, "/** x */", "function ("])
def test_extraction_survives(text):
    assert isinstance(extract(text), list)


def test_a_bare_comment_end_stays_inside():
    source, family = source_of("f(a)", "Ends with */ inside.")
    assert extract(source, family=family)[0].doc.count("*/") == 1


def found(text, path=None):
    return {f.name: (f.signature, " ".join(x for x in plain(f.doc) if x)) for f in extract(text, path)}


def test_each_family_has_its_comments_strings_and_bodies():
    c = found("#include <x.h>\n#define MAX_RETRIES 5 \\\n  /* more */\nint run(int a)\n{\n    return '}' + a;\n}\n\n/* Adds without a carry. */\nstatic int add(int a)\n{\n}\n")
    assert c == {"run": ("int run(int a)", ""), "add": ("static int add(int a)", "Adds without a carry.")}
    py = found("class Foo:\n    def bar(self):\n        'Never blocks.'\n\ndef f(a, b=10 // 3):\n    # inner\n    return {'}': a // b}\n\nasync def g(a,\n      b):\n    pass\n")
    assert py["bar"] == ("def bar(self)", "'Never blocks.'") and py["f"] == ("def f(a, b=10 // 3)", "") and "g" in py
    ts = found("/** Never blocks. */\nasync load(key: string): Promise<{a: number}> {\n  return `}${key}`;\n}\n// Runs once.\nconst f = (s) => {\n  g(s);\n};\n// Short.\nexport const h = (x: number): number => x + 1;\nconst o = {\n  // Inner.\n  k() { return 1; },\n};\n")
    assert ts["load"] == ("async load(key: string): Promise<{a: number}>", "Never blocks.") and ts["f"] == ("const f = (s) =>", "Runs once.") and ts["h"][1] == "Short." and ts["k"][1] == "Inner."
    rb = found("# Never blocks.\ndef run(a)\n  if a\n    b.each do |x|\n      puts \"#{x} end\"\n    end\n  end\nend\n\n# Twice.\ndef empty?\nend\n")
    assert rb == {"run": ("def run(a)", "Never blocks."), "empty?": ("def empty?", "Twice.")}
    text = "-- Never blocks.\nlocal function run(a)\n  if a then\n    return 1\n  end\nend\n-- Not this.\nx = 1\nfunction bare()\nend\n"
    assert found(text) == {"run": ("local function run(a)", "Never blocks."), "bare": ("function bare()", "")} and text[extract(text)[0].end :].startswith("\n-- Not")
    rust = found("/// Never blocks.\n#[inline]\npub fn run<'a>(x: &'a str, y: &'a str) -> &'a str {\n    let c = '}';\n    x\n}\n")
    assert rust["run"][1] == "Never blocks." and rust["run"][0].startswith("pub fn run<'a>")
    cs = found("/// Never blocks.\n[Pure]\npublic int Run(int a)\n    where T : class\n{\n    return a;\n}\n", "a.cs")
    assert cs["Run"][1] == "Never blocks."
    sh = found("#!/bin/bash\n\n# Never blocks.\nrun() {\n  echo ${#x} '}'\n}\n")
    assert sh == {"run": ("run()", "Never blocks.")}


@pytest.mark.parametrize("line", ["return x;", "a.b(c, d)", "x[1].y = f(z)", "if (a) {", "} else {", "const s = 'the end of it'", "for (i = 0; i < n; i++)", "});", "import a.b.c", "print(x)", "self.a += 1", "f(g(h(1, 2)), [3]) {"])
def test_leftover_code_is_lexed(line):
    assert is_code(line)


@pytest.mark.parametrize("line", ["Never blocks", "Waits for it (or not)", "the end; then more", "Reads a.b and c", "Calls f(x) before the lock", "Import ledger", "if the lock is held", "Keeps x = y while it runs."])
def test_prose_is_no_code(line):
    assert not is_code(line)


def test_only_the_lexer_pairs():
    """A remark that belongs to other code, or is parted by a blank line, documents nothing, whatever it says."""
    assert found("// Never blocks.\n\nfunction f() {\n}\n") == {"f": ("function f()", "")}
    assert found("x = 1; // Never blocks.\nfunction f() {\n}\n") == {"f": ("function f()", "")}


def test_nodes_and_documents(spark):
    kind = "id long, symbol_name string, signature string, docstring string, place int"
    rows = [(1, "f", "f(a)", "Never blocks.", 0), (2, "f", "f(a)", "f", 0), (3, "f", " ", "Never blocks.", 0), (4, "f", None, "Never blocks.", 0), (5, None, "def g(x) -> int", "'''Runs once.'''", 0), (6, "f", "f(", "Never } blocks { here", 0), (1, "f", "f(a)", "Never blocks.", 0), (7, "f", "f()", None, 0)]
    df = spark.createDataFrame(rows, kind)
    assert sorted(r.id for r in documented(df).collect()) == [1, 1, 5, 6]
    assert documented(df.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "/** Never blocks. */\nfunction f(a) {\n}\n/** f */\nfunction f() {}", "x"), (2, None, "x"), (3, "", "x"), (4, "no code here", "x")], "doc_id long, text string, name string")
    assert [(r.doc_id, r.name, r.docstring) for r in source_pairs(docs).collect()] == [(1, "f", "Never blocks.")]


def test_every_head_of_the_lexer_reaches_it(spark):
    texts = [
        "/** Adds without a carry. */\nint Add(int a)\n{\n    return a;\n}\n",
        "/** Never blocks. */\nvoid run(int a) throws " + ", ".join(f"SomeLongNamedException{i}" for i in range(6)) + " {\n}\n",
        "# Never blocks.\nsub run {\n}\n",
        "/** Never blocks. */\nfun/**/ction run {\n}\n",
    ]
    wanted = [(i, f.name) for i, t in enumerate(texts) for f in extract(t)]
    assert {i for i, _ in wanted} == set(range(len(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.name) for r in source_pairs(docs).collect()) == wanted
