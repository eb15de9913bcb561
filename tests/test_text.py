import pytest
from pyspark.sql import functions as F

from quarrygraph.functions import rules as R
from quarrygraph.functions import text as T
from quarrygraph.operators import codegraph as G


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("()", 0), ("(void)", 0), ("(int x)", 1), ("(int x, int y)", 2), ("(Map<String, List<Integer>> map, int count)", 2), ("(int (*callback)(int, int), int x)", 2), (None, 0)])
def test_parameter_count(spark, text, want):
    assert one(spark, T.parameter_count(F.col("p")), p=text) == want


@pytest.mark.parametrize("text", ["", None])
def test_empty_source(spark, text):
    assert one(spark, T.cyclomatic(F.col("s"), F.lit("c")), s=text) == 1
    assert one(spark, T.nesting(F.col("s")), s=text) == 0
    assert one(spark, T.lines_of_code(F.col("s")), s=text) == 0


def test_complexity(spark):
    src = "int f(int a) {\n  // note\n  if (a && b) {\n    for (;;) { g(); }\n  } else if (c) { }\n\n}\n"
    assert one(spark, T.cyclomatic(F.col("s"), F.lit("c")), s=src) == 1 + 2 + 1 + 1 + 1
    assert one(spark, T.nesting(F.col("s")), s=src) == 3
    assert one(spark, T.lines_of_code(F.col("s")), s=src) == 5
    assert one(spark, T.nesting(F.col("s")), s="def f():\n    if a:\n        x = 1\n") == 2


@pytest.mark.parametrize("n,want", [(3, "low"), (8, "moderate"), (15, "high"), (25, "very_high")])
def test_rating(spark, n, want):
    assert spark.range(1).select(T.rating(F.lit(n)).alias("x")).first()["x"] == want


def test_tokens_and_similarity(spark):
    assert set(one(spark, T.tokens(F.col("s")), s="a ab abc function if for // gone\n")) == {"abc", "function", "for"}
    assert one(spark, T.trigram_similarity(F.col("s"), F.lit("word")), s="word") == 1.0
    assert one(spark, T.trigram_similarity(F.col("s"), F.lit("xyz")), s="word") == 0.0


@pytest.mark.parametrize("name,want", [("myVariableName", "camelCase"), ("MyClassName", "PascalCase"), ("my_variable_name", "snake_case"), ("MY_CONSTANT_VALUE", "SCREAMING_SNAKE_CASE"), ("123invalid", "unknown")])
def test_naming_styles(spark, name, want):
    df = spark.createDataFrame([(1, 1, name, "function", "python")], "id long, project_id int, symbol string, type string, language string")
    assert want in G.naming_compliance(df).first()["detected"].split(",")


@pytest.mark.parametrize("name,lang,want", [("foo.test.js", "javascript", True), ("src/tests/foo.js", "javascript", True), ("test_foo.py", "python", True), ("foo_test.go", "go", True), ("FooTest.java", "java", True), ("foo.js", "javascript", False), ("testing.js", "javascript", False), ("foo.py", "python", False)])
def test_test_files(spark, name, lang, want):
    assert one(spark, F.col("f").rlike(R.TEST_FILES[lang]), f=name) is want


def entity(spark, rows):
    cols = "id long, project_id int, language string, symbol string, type string, filename string, source string, start_line int, end_line int, parameters string, comment string, return_type string"
    return spark.createDataFrame(rows, cols)


def test_dead_code_and_entry_points(spark):
    e = entity(spark, [(1, 1, "c", "main", "function", "a.c", "x", 1, 10, "()", None, None), (2, 1, "c", "calculate", "function", "a.c", "x", 12, 25, "()", None, None), (3, 1, "c", "unused", "function", "a.c", "x", 27, 35, "()", None, None), (4, 2, "c", "other", "function", "b.c", "x", 1, 2, "()", None, None)])
    r = spark.createDataFrame([(1, 1, 2, 2, None), (2, 4, 3, 1, None)], "id long, caller long, callee long, line int, comment string")
    got = {x["symbol"]: x["entry_point"] for x in G.dead_code(e, r).collect()}
    assert got == {"main": True, "unused": False, "other": False}  # a call from another project does not count
    s = {x["project_id"]: x for x in G.dead_code_summary(e, r).collect()}
    assert s[1]["dead_functions"] == 1 and s[1]["dead_lines"] == 9


def test_duplicates_equal_brute_force(spark):
    body = "alpha beta gamma delta epsilon zeta theta kappa lambda sigma omega"
    rows = [(i, 1, "c", f"f{i}", "function", "a.c", body.replace("omega", f"omega{i}") if i < 4 else "one two three other words entirely here", 1, 8, "()", None, None) for i in range(6)]
    pairs = {(x["id_a"], x["id_b"]) for x in G.duplicate_pairs(entity(spark, rows)).collect()}
    assert pairs == {(a, b) for a in range(4) for b in range(a + 1, 4)} | {(4, 5)}


def test_upsert_keeps_the_newest(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("b", None, "only"), ("a", 2, "mid")], "k string, v int, x string")
    assert {tuple(r) for r in G.newest(df, ["k"], ["v"]).select("k", "x").collect()} == {("a", "new"), ("b", "only")}


def test_types(spark):
    rows = [(1, 1, "javascript", "a", "function", "a.js", "return 'x';", 1, 1, "()", None, None), (2, 1, "javascript", "b", "function", "a.js", "return 4;", 1, 1, "()", None, None), (3, 1, "python", "c", "function", "a.py", "def c() -> int: return 1", 1, 1, "()", None, None), (4, 1, "javascript", "d", "function", "a.js", "return;", 1, 1, "()", None, None)]
    got = {x["symbol"]: (x["has_hint"], x["inferred"]) for x in G.type_inference(entity(spark, rows)).collect()}
    assert got == {"a": (False, "string"), "b": (False, "number"), "c": (True, None), "d": (False, "unknown")}


def test_coverage_gaps(spark):
    rows = [(1, 1, "javascript", "a", "function", "src/reader.js", "x", 1, 1, "()", None, None), (2, 1, "javascript", "b", "function", "src/writer.js", "x", 1, 1, "()", None, None), (3, 1, "javascript", "c", "function", "tests/reader.test.js", "x", 1, 1, "()", None, None), (4, 2, "javascript", "d", "function", "src/reader.js", "x", 1, 1, "()", None, None)]
    assert {(r["project_id"], r["filename"]) for r in G.coverage_gaps(entity(spark, rows)).collect()} == {(1, "src/writer.js"), (2, "src/reader.js")}


def test_concurrency_and_resources(spark):
    rows = [(1, 1, "go", "a", "function", "a.go", "mu.Lock()\ngo run(x)", 1, 1, "()", None, None), (2, 1, "swift", "b", "function", "b.swift", "x.then(y)", 1, 1, "()", None, None), (3, 1, "c", "c", "function", "c.c", "p = malloc(4);", 1, 1, "()", None, None), (4, 1, "python", "d", "function", "d.py", "with open(x) as f: pass", 1, 1, "()", None, None)]
    e = entity(spark, rows)
    found = G.concurrency_findings(e)
    assert {(r["id"], r["kind"]) for r in found.collect()} == {(1, "lock_acquire"), (1, "goroutine_call"), (2, "promise_then")}
    assert {(r["id"], r["warning"]) for r in G.concurrency_warnings(found).collect()} == {(1, "lock_not_released"), (2, "shared_state_no_lock")}
    assert {(r["id"], r["resource"], r["leak"]) for r in G.resource_findings(e).collect()} == {(3, "malloc/free", True), (4, "open", False)}


def test_readability_score(spark):
    good = "int readTotal(int firstValue) {\n    // adds the next value\n    int nextValue = firstValue + 1;\n    return nextValue;\n}\n"
    bad = "int f(int a){if(a&&a||a&&a||a&&a||a){while(a){if(a){for(;;){g(37+41+53+67+71+73+79+83+89+91+97);}}}}return " + "a+" * 90 + "3;}"
    rows = [(1, 1, "c", "a", "function", "a.c", good, 1, 5, "()", None, None), (2, 1, "c", "b", "function", "a.c", bad, 1, 1, "()", None, None), (3, 1, "c", "c", "function", "a.c", "", 1, 1, "()", None, None)]
    got = {r["id"]: r for r in G.readability_score(entity(spark, rows)).collect()}
    assert set(got) == {1, 2} and got[1]["rating"] == "excellent" and got[1]["number_score"] == 100 and got[2]["score"] < 55 and got[2]["number_score"] < 50


@pytest.mark.parametrize("name,want", [("q", {"too_short"}), ("i", set()), ("a" * 41, {"too_long"}), ("__x", {"double_underscore"}), ("__init__", set()), ("_9lives", {"starts_with_number"}), ("a__b", {"consecutive_underscores"}), ("someName_with", {"mixed_conventions"}), ("fine_name", set())])
def test_naming_issues(spark, name, want):
    df = spark.createDataFrame([(1, 1, name)], "id long, project_id int, symbol string")
    assert {r["issue"] for r in G.naming_issues(df).collect()} == want


def test_import_cycles(spark):
    rows = [(1, "a/one.py", "import two\n"), (1, "b/two.py", "from one import x\n"), (1, "c/three.py", "import one\n"), (2, "a/one.js", "const t = require('./two');\n"), (2, "two.js", "x = 1 // import one\n"), (1, None, "import one"), (1, "d.py", None)]
    df = spark.createDataFrame(rows, "project_id int, filename string, source string")
    assert [tuple(r) for r in G.import_cycles(df).collect()] == [(1, "a/one.py", "b/two.py")]
