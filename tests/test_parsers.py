from codeweft.sources import code, files, parsers

F_ = "path string, text string"


def one(spark, path, text):
    return spark.createDataFrame([(path, text)], F_)


def test_markdown(spark):
    text = "intro\n# One two!\nbody\n\n### deep\n## Two\n#no\n# \n"
    got = [tuple(r) for r in parsers.markdown_sections(one(spark, "a.md", text)).orderBy("number").collect()]
    assert got == [("a.md", 1, "One two!", "one-two", 2, 5, "body\n\n### deep"), ("a.md", 2, "Two", "two", 6, 7, "#no")]
    assert parsers.markdown_sections(spark.createDataFrame([("a", None), ("b", "")], F_)).count() == 0


def test_json(spark):
    rows = [("a", '{"x": 1, /* c */ "y": {"z": 1}} // end'), ("b", "[1, 2]"), ("c", '{"u": "http://x"}'), ("d", "broken"), ("e", None)]
    got = sorted(tuple(r) for r in parsers.json_keys(spark.createDataFrame(rows, F_)).collect())
    assert got == [("a", "x"), ("a", "y"), ("b", "0"), ("b", "1")]


def test_dependencies(spark):
    rows = [("p/package.json", '{"dependencies": {"a": "1", "b": "2"}, "devDependencies": {"b": "3"}}'), ("package.json", "broken"), ("requirements.txt", "# c\nflask>=1.2\n\nnumpy\r\n-e .")]
    got = sorted((r.package, r.version) for r in parsers.dependencies(spark.createDataFrame(rows, F_)).collect())
    assert got == [("package:a", "1"), ("package:b", "3"), ("pypi:-e", "latest"), ("pypi:flask", "1.2"), ("pypi:numpy", "latest")]


def test_imports(spark):
    rows = [
        ("a/b/c.py", "import os.path\nfrom x.y import z\nfrom ..pkg.mod import q\nclass A(Base):\n  pass"),
        ("t.ts", "import {x} from '@s/p/q';\nimport y from './local';\nclass K extends L implements M {}"),
        ("m.rs", "use std::io::Read;\nmod inner;"),
        ("e.go", 'import (\n  "fmt"\n  "a/b"\n)'),
        ("c.c", "#include <stdio.h>"),
        ("g.gd", "extends Node"),
        (None, "import os"),
    ]
    got = {(r.path, r.target, r.edge_type) for r in parsers.imports(spark.createDataFrame(rows, F_)).collect()}
    assert {t for p, t, _ in got if p == "a/b/c.py"} == {"pypi:os", "pypi:x", "a/pkg/mod.py", "a/pkg/mod/__init__.py", "Base"}
    assert {t for p, t, _ in got if p == "t.ts"} == {"package:@s/p", "L", "M"}
    assert {t for p, t, _ in got if p == "m.rs"} == {"crate:Read", "/inner.rs", "/inner/mod.rs"}
    assert {t for p, t, _ in got if p in ("e.go", "c.c", "g.gd")} == {"fmt", "a/b", "header:stdio.h", "class:Node"}


def test_python_symbols():
    p = code.parse("a.py", 'class A(B):\n    """Doc."""\n    def f(self, x=1):\n        return g(x) if x and 1 else h(x)\n\ndef g(x):\n    for i in x:\n        print(i)\n\ndef test_it():\n    assert g(1) == 2\n')
    by = {n[0]: n for n in p.nodes}
    assert {n: x[1] for n, x in by.items()} == {"A": "class", "A.f": "method", "g": "function", "test_it": "function"}
    assert by["A"][7] == "Doc." and by["A.f"][6] == 3 and by["g"][6] == 2 and by["A.f"][4] == "f(self, x=1)"
    assert ("A.f", "g", "calls", False, 4) in p.edges and ("A.f", "h", "calls", True, 4) in p.edges and ("A", "B", "inherits", False, 1) in p.edges
    assert p.specs == [("test_it", "test_it", ["assert g(1) == 2"], 10)]
    assert code.parse("a.py", "def broken(").nodes == [] and code.parse(None, "x").nodes == code.parse("a.py", None).nodes == []


def test_lexed_languages():
    ts = code.parse("a.ts", "/** Doc. */\nexport function f(a: string): void {\n  if (a && '}' !== a) { g(a); } // if\n}\nclass K {\n  private m(x) { return f(x); }\n}\n")
    by = {n[0]: n for n in ts.nodes}
    assert by["f"][1:4] == ("function", 2, 4) and by["f"][6] == 3 and by["f"][7] == "Doc." and by["K.m"][1] == "method" and by["K.m"][5] == "private"
    assert ("f", "g", "calls", True, 3) in ts.edges and ("K.m", "f", "calls", False, 6) in ts.edges
    go = code.parse("a.go", "type S struct {\n}\nfunc (s *S) M(x int) int {\n\tfor i := 0; i < x && x > 1; i++ {\n\t}\n\treturn x\n}\nfunc TestX(t *testing.T) {\n\tt.Fatal(1)\n}\n")
    assert {n[0]: (n[1], n[6]) for n in go.nodes} == {"S": ("class", 1), "M": ("method", 3), "TestX": ("function", 1)} and go.specs[0][0] == "TestX"
    rs = code.parse("a.rs", "struct A {}\nimpl A {\n  fn f(&self) -> u8 { match 1 { 1 => 2, _ => 3 } }\n}\n#[test]\nfn t() { assert_eq!(1, 1); }\n")
    assert {n[0] for n in rs.nodes} == {"A", "A.f", "t"} and rs.specs[0][:2] == ("t", "t")
    gd = code.parse("a.gd", "class_name P\nsignal hit\nfunc go(x):\n\tif x:\n\t\tstop()\n\nfunc b():\n\tpass\n")
    assert {n[0]: n[1] for n in gd.nodes}["hit"] == "field" and next(n for n in gd.nodes if n[0] == "go")[2:5] == (3, 5, "func go(x)")
    y = code.parse("w.yml", "name: x\njobs:\n  build:\n    steps:\n      - uses: a/b@v1\n")
    assert [n[0] for n in y.nodes] == ["name", "jobs", "job:build"] and y.edges[-1][:3] == ("job:build", "a/b@v1", "calls")


def test_symbols_as_rows_and_plugins(spark):
    code.register("zz", lambda text: code.Parsed(nodes=[(text, "function", 1, 1, None, "public", 1, None)]))
    df = spark.createDataFrame([("x.zz", "made"), ("y.py", "def f(): pass"), ("z.unknown", "q"), (None, None)], F_)
    assert {(r.path, r.name) for r in code.symbols(df).collect()} == {("x.zz", "made"), ("y.py", "f")}
    assert code.relations(df.limit(0)).count() == 0 == code.specs(df).count()


def test_production_files(spark):
    df = spark.createDataFrame([(x,) for x in ("src/a/foo.ts", "src/a/foo.test.ts", "lib/deep/er/bar.ts", "lib/bar.ts", "tests/bar.spec.ts", "src/barbaz.ts", "x/__tests__/none.ts")], "path string")
    got = {r.path: r.production for r in parsers.production_files(df).collect()}
    assert got == {"src/a/foo.test.ts": "src/a/foo.ts", "tests/bar.spec.ts": "lib/bar.ts"}


def test_ignore_rules_and_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    for p, t in (("a/x.py", "1"), ("a/y.log", "2"), ("keep.log", "3"), ("node_modules/z.py", "4"), ("big.py", "x" * 100)):
        (tmp_path / p).write_text(t)
    got = {r.path.rsplit("/", 1)[-1] for r in files.tree(spark, str(tmp_path), ["# c", "*.log", "!keep.log"], most=50).collect()}
    assert got == {"x.py", "keep.log"}
