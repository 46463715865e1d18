import itertools
import math
import random

import pytest

from codeweft.llm.provenance import LABELS, Model, labelled

KIND = "id long, version long, symbol_type string, file_path string, qualified_name string, checksum string, docstring string, is_generated boolean, loc int, cyclomatic int, path string, label string"


def rows_of(*rows):
    base = {"version": 1, "symbol_type": "file", "file_path": None, "qualified_name": None, "checksum": None, "docstring": None, "is_generated": None, "loc": 100, "cyclomatic": 9, "path": "clash", "label": "clash"}
    return [tuple((base | {"id": i} | r)[c.split()[0]] for c in KIND.split(", ")) for i, r in enumerate(rows)]


def run(spark, *rows):
    known = spark.createDataFrame([("k1", "x"), (None, "y"), ("", "z")], "checksum string, file_path string")
    return {r.node_id: r for r in labelled(spark.createDataFrame(rows_of(*rows), KIND), known).collect()}


CASES = [
        ({"file_path": "/a/b.ts"}, "handwritten"),
        ({"file_path": "/a/b.ts", "is_generated": True}, "generated"),
        ({"file_path": "/a/b.pb.go"}, "generated"),
        ({"file_path": "/a/b_pb2.py"}, "generated"),
        ({"file_path": "/a/generated_id.ts"}, "handwritten"),
        ({"file_path": "/a/autogen_check.py"}, "handwritten"),
        ({"file_path": "\\A\\X.Min.js"}, "minified"),
        ({"file_path": "/a/minimum.js"}, "handwritten"),
        ({"file_path": "/a/b.js", "loc": 2, "cyclomatic": 900}, "minified"),
        ({"file_path": "/a/b.js", "loc": 1, "cyclomatic": 1}, "handwritten"),
        ({"file_path": "/a/node_modules/q/lib/b.js"}, "vendored"),
        ({"file_path": "/a/vendor_portal/b.js"}, "handwritten"),
        ({"file_path": "/a/vendors/b.js"}, "handwritten"),
        ({"file_path": "/a/b.js", "checksum": "k1"}, "vendored"),
        ({"file_path": "/a/b.js", "checksum": ""}, "handwritten"),
        ({"file_path": "/a/target/classes/b.java"}, "generated"),
        ({"file_path": "/a/targets/b.java"}, "handwritten"),
        ({"file_path": "/a/t.py", "loc": 30000, "cyclomatic": 0}, "blob"),
        ({"file_path": "/a/t.json", "loc": 30000, "cyclomatic": 0}, "handwritten"),
        ({"file_path": "/a/t.py", "loc": 300, "cyclomatic": 0}, "handwritten"),
        ({"file_path": "/a/t.py", "loc": None, "cyclomatic": None}, "handwritten"),
        ({"file_path": "/a/b.ts", "docstring": "// Code generated by x. DO NOT EDIT."}, "generated"),
        ({"file_path": "/a/b.ts", "docstring": "/**\n * @generated by x\n */"}, "generated"),
        ({"file_path": "/a/b.ts", "docstring": "Diese Datei wurde von x erzeugt und nicht bearbeiten."}, "generated"),
        ({"file_path": "/a/b.ts", "docstring": "Parser for generated sources; reads what x wrote."}, "handwritten"),
        ({"file_path": "/a/b.ts", "docstring": "Writes the DO NOT EDIT header into the files made by x."}, "handwritten"),
        ({"file_path": None, "qualified_name": "/a/q.gen.ts"}, "generated"),
        ({"file_path": None, "qualified_name": None}, "handwritten"),
]


def test_evidence(spark):
    got = run(spark, *[r for r, _ in CASES])
    assert [got[i].label for i in range(len(CASES))] == [x for _, x in CASES]


def test_only_the_tree_tells_equal_rows_apart(spark):
    """Middling density alone says nothing; among minified siblings it does. A declared folder labels plain rows below."""
    odd = {"loc": 100, "cyclomatic": 250}
    packed = [{"file_path": f"/p/b/g{i}.js", "loc": 2, "cyclomatic": 900} for i in range(12)]
    hand = [{"file_path": f"/p/{d}/g{i}.{e}"} for d, e in (("c", "js"), ("b", "ts")) for i in range(12)]
    got = run(spark, odd | {"file_path": "/p/c/x.js"}, odd | {"file_path": "/p/b/x.js"}, odd | {"file_path": "/p/b/x.ts"}, {"file_path": "/p/vendor/deep/er/x.js"}, {"file_path": "/p/vendored/x.js"}, *packed, *hand)
    assert [got[i].label for i in range(5)] == ["handwritten", "minified", "handwritten", "vendored", "handwritten"]
    assert all(got[i].label == "handwritten" for i in range(17, 41))


def test_siblings_do_not_turn_a_plain_row(spark):
    among = [{"file_path": f"/p/b/g{i}.gen.ts"} for i in range(4)]
    got = run(spark, {"file_path": "/p/a/x.ts"}, {"file_path": "/p/b/x.ts"}, *among, {"file_path": "/p/vendor/y.ts"}, {"file_path": "/p/z.ts"})
    assert got[0].label == got[1].label == got[7].label == "handwritten" and got[1].probability < got[0].probability


def test_current_rows_count(spark):
    got = run(spark, {"id": 1, "version": 2, "file_path": "/a.ts"}, {"id": 1, "version": 1, "file_path": "/a.ts", "is_generated": True}, {"id": 2, "symbol_type": "FILE "}, {"id": 3, "symbol_type": "class"}, {"id": 4, "symbol_type": None})
    assert {k: r.label for k, r in got.items()} == {1: "handwritten", 2: "handwritten"}
    assert run(spark) == {}


def test_partitions_are_stitched_exactly(spark):
    """Many small partitions against one; a directory with a third of all files spans several."""
    rnd = random.Random(4)
    paths = [f"/r/hot/f{i}.{rnd.choice(['js', 'ts'])}" for i in range(100)] + ["/r/" + "/".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6))) + f"/f{i}.{rnd.choice(['js', 'ts', 'min.js'])}" for i in range(200)] + ["x.js", "", "/", "a//b.js"]
    rows = rows_of(*[{"file_path": p, "loc": 100, "cyclomatic": rnd.choice([9, 150, 300, 900, None]), "is_generated": rnd.random() < 0.1} for p in paths])
    df, known = spark.createDataFrame(rows, KIND), spark.createDataFrame([], "checksum string")
    whole, parts = ({r.node_id: (r.label, r.probability) for r in labelled(df, known, files_per_task=n).collect()} for n in (1000, 7))
    assert {k: v[0] for k, v in whole.items()} == {k: v[0] for k, v in parts.items()} and len(whole) == len(paths)
    assert all(v[1] == pytest.approx(parts[k][1], abs=2e-6) for k, v in whole.items())


def test_propagation_is_exact_on_a_small_tree(spark):
    """Against the sum over all labellings of directories, groups and files."""
    m = Model()
    rows = [{"file_path": "/r/a/x.js", "loc": 100, "cyclomatic": 900}, {"file_path": "/r/a/y.js"}, {"file_path": "/r/z.js", "loc": None}]
    got = run(spark, *rows)
    own = [[0, 0, 2 * math.log2(9), 0, 0], [-x for x in m.looks], [-x / 2 for x in m.looks]]
    up = {"": None, "/r": "", "/r/a": "/r", "g1": "/r/a", "g2": "/r"}
    group = ["g1", "g1", "g2"]
    files, folders = m.files(), m.folders()
    joint = [[0.0] * 5 for _ in rows]
    names = list(up)
    for d in itertools.product(range(5), repeat=len(names)):
        at = dict(zip(names, d))
        tree = math.prod(math.exp(folders[0 if p is None else at[p], at[c]]) for c, p in up.items())
        if not tree:
            continue
        for f in itertools.product(range(5), repeat=3):
            w = tree * math.prod(math.exp(own[i][x] + files[at[group[i]], x]) for i, x in enumerate(f))
            for i, x in enumerate(f):
                joint[i][x] += w
    for i, j in enumerate(joint):
        assert got[i].label == LABELS[j.index(max(j))] and got[i].probability == pytest.approx(max(j) / sum(j), abs=2e-6)
