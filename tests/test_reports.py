import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrygraph.functions import text as T
from quarrygraph.operators import catalog as C
from quarrygraph.operators import codegraph as G
from quarrygraph.operators import reports as P

SCHEMA = "id long, project_id int, language string, symbol string, type string, filename string, source string, start_line int, end_line int, comment string"


def functions(spark, *rows):
    """Functions (language, source) with ids from 1."""
    return spark.createDataFrame([(i, 1, lang, f"f{i}", "function", f"f{i % 2}.x", src, i, i + 9, None) for i, (lang, src) in enumerate(rows, 1)], SCHEMA)


CONCURRENT = [
    ("rust", "let h = std::thread::spawn(move || { tokio::time::sleep(d).await; });", {"thread_spawn", "thread_spawn_call", "tokio", "await"}, {"shared_state_no_lock"}),
    ("rust", "let m = Mutex::new(1); let g = m.lock().unwrap();", {"mutex", "lock_acquire"}, {"lock_not_released"}),
    ("cpp", "std::thread t(run); std::lock_guard<std::mutex> l(m);", {"thread", "lock_guard", "mutex"}, set()),
    ("cpp", "auto f = std::async(run); co_await f;", {"async", "co_await"}, {"shared_state_no_lock"}),
    ("typescript", "async function a(): Promise<number> { await b(); }", {"async_function", "promise_type", "await"}, {"shared_state_no_lock"}),
    ("csharp", "async Task Run() { await x; lock (o) { } }", {"async_task", "await", "lock"}, set()),
    ("python", "lock.acquire()\nlock.release()", {"lock_acquire", "lock_release"}, set()),
    ("go", "mu.Lock(); go work(x)", {"lock_acquire", "goroutine_call"}, {"lock_not_released"}),
    ("java", "new Thread(r).start();", {"thread"}, {"shared_state_no_lock"}),
    ("c", "x = setTimeout(f, 3);", {"setTimeout"}, set()),
    ("rust", "let x = 1;", set(), set()),
]


def test_concurrency(spark):
    e = functions(spark, *[x[:2] for x in CONCURRENT])
    found = G.concurrency_findings(e)
    rows, warned = found.collect(), G.concurrency_warnings(found).collect()
    for i, (_, _, kinds, warnings) in enumerate(CONCURRENT, 1):
        assert {r["kind"] for r in rows if r["id"] == i} == kinds
        assert {r["warning"] for r in warned if r["id"] == i} == warnings


RESOURCES = [
    ("c", "p = malloc(4); if (p == NULL) return; free(p);", {("malloc/free", False)}, set(), set()),
    ("c", "p = malloc(4);", {("malloc/free", True)}, set(), {"malloc_no_null_check"}),
    ("c", "pthread_mutex_init(&m, 0);", {("pthread_mutex_init/destroy", True)}, set(), set()),
    ("cpp", "auto* a = new Thing(1);", {("new/delete", True)}, set(), {"raw_new_without_smart_ptr"}),
    ("cpp", "std::unique_ptr<T> a(new T);", {("new/delete", True)}, {"unique_ptr"}, set()),
    ("typescript", "const t = setInterval(f, 1); clearInterval(t);", {("setInterval/clearInterval", False)}, set(), set()),
    ("csharp", "var s = new FileStream(p);", {("IDisposable", True), ("Stream", True)}, set(), set()),
    ("csharp", "using (var s = new FileStream(p)) { }", {("IDisposable", False), ("Stream", False)}, {"using statement"}, set()),
    ("rust", "let r = Box::into_raw(Box::new(1));", {("Box::into_raw/from_raw", True)}, {"Box"}, set()),
    ("go", "f, _ := os.Open(p); defer f.Close()", {("os.Open/Close", False)}, {"defer statement"}, set()),
    ("go", "rows := db.Query(q)", {("Rows/Close", True)}, set(), set()),
    ("python", "with open(p) as f:\n    pass", {("open", False)}, {"with statement"}, set()),
    ("java", "Statement s = c.createStatement();", {("Statement", True)}, set(), set()),
    ("javascript", "bus.on('x', f);", {("on/off", True)}, set(), set()),
]


def test_resources(spark):
    e = functions(spark, *[x[:2] for x in RESOURCES])
    rows, held, warned = G.resource_findings(e).collect(), G.resource_holders(e).collect(), G.resource_warnings(e).collect()
    for i, (_, _, taken, safe, warnings) in enumerate(RESOURCES, 1):
        assert {(r["resource"], r["leak"]) for r in rows if r["id"] == i} == taken
        assert {r["resource"] for r in held if r["id"] == i and r["finding"] == "safe"} == safe
        assert {r["warning"] for r in warned if r["id"] == i} == warnings


PATTERNS = [
    ("javascript", "static getInstance() { return x; }", {"singleton"}), ("java", "private static Conf instance;", {"singleton"}), ("go", "var once sync.Once", {"singleton"}), ("python", "class ShapeFactory:\n    pass", {"factory"}),
    ("java", "class LegacyAdapter implements Port { }", {"adapter"}), ("java", "class LegacyAdapter { }", set()), ("rust", "struct CacheProxy { }", {"proxy"}), ("typescript", "interface PayStrategy { }", {"strategy"}), ("go", "type StoreObserver interface {}", {"observer"}),
    ("python", "def __iter__(self):\n    yield 1", {"iterator"}), ("rust", "enum DoorState { Open }", {"state"}), ("java", "void undo() { }", {"command"}), ("javascript", "go(() => { a(() => { b(() => { c(); }) }) })", {"callback_hell"}),
    ("cpp", "class RowBuilder { };", {"builder"}), ("typescript", "class SkinDecorator { }", {"decorator"}), ("python", "class DiskFacade:\n    pass", {"facade"}), ("python", "x = 1", set()),
]


def test_design_patterns(spark):
    rows = G.design_patterns(functions(spark, *[x[:2] for x in PATTERNS])).collect()
    for i, (_, _, want) in enumerate(PATTERNS, 1):
        assert {r["pattern"] for r in rows if r["id"] == i} == want


def test_places_and_truncation(spark):
    e = functions(spark, *[("python", "await x")] * 25)
    got = P.finding_places(G.concurrency_findings(e), e, ["kind"]).collect()
    assert len(got) == 20 and all(r["total"] == 25 and r["truncated"] for r in got)
    assert [r["filename"] for r in sorted(got, key=lambda r: r["rank"])][:3] == ["f0.x", "f0.x", "f0.x"]
    assert not any(r["truncated"] for r in P.finding_places(G.concurrency_findings(e), e, ["kind"], 25).collect())
    one = P.share_of_functions(G.concurrency_findings(e), e).first()
    assert (one["functions"], one["with_findings"], one["percentage"]) == (25, 25, 100.0)


def test_names_that_show_nothing_in_the_tables(spark):
    rows = [(i, 1, "python", s, "function", "a.py", "x", 1, 2, None) for i, s in enumerate(["load1", "load2", "load3", "a", "x", "n" * 41, "a__b", "myVar_x", "plain", "lambda", "__init__", "$gen"], 1)]
    e = spark.createDataFrame(rows, SCHEMA)
    assert [(r["base_name"], r["n"], r["severity"]) for r in G.name_suspects(e).collect()] == [("load", 3, "low")]
    both = G.naming_issues(e).unionByName(G.naming_word_issues(e))
    assert {(r["symbol"][:7], r["issue"]) for r in both.collect()} == {
        ("a", "too_short"), ("a", "uncommon_abbreviation"), ("x", "uncommon_abbreviation"), ("nnnnnnn", "too_long"), ("a__b", "consecutive_underscores"), ("a__b", "uncommon_abbreviation"),
        ("myVar_x", "mixed_conventions"), ("myVar_x", "uncommon_abbreviation"), ("lambda", "reserved_word"),
    }


def test_circles_of_files(spark):
    rows = [(i, 1, "python", f"f{i}", "function", name, "x", 1, 2, None) for i, name in enumerate(["a.py", "b.py", "c.py"], 1)]
    e = spark.createDataFrame(rows, SCHEMA)
    calls = spark.createDataFrame([(1, 1, 2, 5), (2, 2, 1, 6), (3, 2, 3, 7)], "id long, caller long, callee long, line int")
    assert [(r["file_a"], r["file_b"]) for r in G.circular_dependencies(G.file_dependencies(calls, e)).collect()] == [("a.py", "b.py")]
    files = spark.createDataFrame([(1, 1, "src/a.py", "import b\n"), (2, 1, "src/b.py", "from a import x\n"), (3, 1, "src/c.py", "import a\n")], "id long, project_id int, filename string, source string")
    assert [(r["file_a"], r["file_b"]) for r in G.import_cycles(files).collect()] == [("src/a.py", "src/b.py")]


def test_symbols_at_a_location(spark):
    refs = spark.createDataFrame([(1, 1, "a.c", 3, "x", "variable", 4, 9, False, False, 7), (2, 1, "a.c", 3, "y", "variable", None, 3, False, False, None), (3, 1, "a.c", 4, "z", "variable", 0, 9, False, False, None)], "id long, project_id int, filename string, line int, symbol string, symbol_type string, column_start int, column_end int, is_definition boolean, is_write boolean, definition_entity_id long")
    e = spark.createDataFrame([(7, "d.c", 40, "(int x)", "int", "doc")], "id long, filename string, start_line int, parameters string, return_type string, comment string")
    at = lambda col: {r["symbol"]: r["definition_line"] for r in G.symbols_at_location(refs, e, spark.createDataFrame([(1, "a.c", 3, col)], "project_id int, filename string, line int, column int")).collect()}
    assert at(4) == {"x": 40} and at(9) == {"x": 40} and at(0) == {"y": None} and at(10) == {} and at(None) == {"x": 40, "y": None}


def test_search_escapes_the_beginning(spark):
    e = spark.createDataFrame([(1, "l_done", "f", "a"), (2, "lxdone", "f", "a"), (3, "al_d", "f", "a"), (4, "other", "f", "a")], "id long, symbol string, type string, filename string")
    assert [(r["symbol"], r["prefix"]) for r in G.entity_search(e, "l_d").collect()] == [("l_done", True), ("al_d", False), ("lxdone", False)]


def test_class_fixture(spark):
    # Animal 1, Dog 2, Cat 3, Runnable 4; Dog has an external parent as well
    e = spark.createDataFrame([(i, 1, s, "class", i == 4) for i, s in enumerate(["Animal", "Dog", "Cat", "Runnable"], 1)], "id long, project_id int, symbol string, type string, is_abstract boolean")
    i = spark.createDataFrame([(1, 2, 1, "Animal", "extends"), (2, 3, 1, "Animal", "EXTENDS "), (3, 2, 4, "Runnable", "implements"), (4, 3, None, "ExternalBaseClass", "embeds")], "id long, child_entity_id long, parent_entity_id long, parent_symbol string, relationship_type string")
    from quarrygraph.operators.hierarchy import forest

    s = P.hierarchy_summary(e, i, forest(spark.createDataFrame([(2, 1), (3, 1)], "child long, parent long"))).first()
    assert (s["classes"], s["roots"], s["leaves"], s["abstract_classes"], s["max_depth"], s["deepest_class"]) == (4, 2, 2, 1, 1, 2)
    assert (s["relations"], s["extends_count"], s["implements_count"], s["embeds_count"], s["children_per_class"]) == (4, 2, 1, 1, 1.0)
    tree = {(r["direction"], r["depth"], r["class_id"], r["relationship_type"]) for r in P.class_tree(i, spark.createDataFrame([(2,)], "node long")).collect()}
    assert tree == {("up", 1, 1, "extends"), ("up", 1, 4, "implements")}
    assert {(r["direction"], r["class_id"]) for r in P.class_tree(i, spark.createDataFrame([(1,)], "node long"), "down").collect()} == {("down", 2), ("down", 3)}
    wide = spark.createDataFrame([(2, "class", None, ["Old"], False), (3, "class", "Kept", None, True)], "id long, type string, parent_class string, interfaces array<string>, is_abstract boolean")
    got = {r["id"]: (r["parent_class"], r["interfaces"]) for r in C.inheritance_update(wide, i).collect()}
    assert got == {2: ("Animal", ["Runnable"]), 3: ("Animal", None)}


def test_tree_ends_in_a_circle(spark):
    i = spark.createDataFrame([(1, 1, 2, "extends"), (2, 2, 3, "extends"), (3, 3, 1, "extends")], "id long, child_entity_id long, parent_entity_id long, relationship_type string")
    got = P.class_tree(i, spark.createDataFrame([(1,)], "node long")).collect()
    assert {(r["direction"], r["depth"], r["class_id"]) for r in got} == {("up", 1, 2), ("up", 2, 3), ("down", 1, 3), ("down", 2, 2)}


def test_upserts(spark):
    day = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", "/a", "git1", day, None), ("b", "/b", None, day, None)], "name string, path string, git_url string, created_at timestamp, updated_at timestamp")
    new = spark.createDataFrame([("a", "/x", None), ("b", "/y", "git2"), ("c", "/c", None)], "name string, path string, git_url string")
    later = F.lit(dt.datetime(2024, 2, 1))
    got = {r["name"]: (r["path"], r["git_url"], r["created_at"].month, r["updated_at"] and r["updated_at"].month) for r in C.project_upsert(old, new, later).collect()}
    assert got == {"a": ("/a", "git1", 1, 2), "b": ("/b", "git2", 1, 2), "c": ("/c", None, 2, None)}
    cache = spark.createDataFrame([(1, "x", '{"n": 1}', day, day), (2, "x", '"{\\"n\\": 5}"', day, day)], "project_id int, analysis_type string, data string, created_at timestamp, updated_at timestamp")
    rows = spark.createDataFrame([(1, "x", '{"n": 2}'), (1, "y", '{"n": 9}')], "project_id int, analysis_type string, data string")
    kept = C.analysis_upsert(cache, rows, later)
    assert {(r["project_id"], r["n"]) for r in C.analysis_read(kept, "x", "n int").collect()} == {(1, 2), (2, 5)}
    assert kept.count() == 3 and kept.filter("analysis_type = 'x' AND project_id = 1").first()["created_at"].month == 1


def test_comments_of_calls(spark):
    calls = spark.createDataFrame([(1, 5, "f"), (1, 9, "g")], "file_id long, line int, symbol string")
    comments = spark.createDataFrame([(1, 4, 4, "late"), (1, 2, 4, "early"), (1, 9, 9, "same line"), (2, 8, 8, "other file")], "file_id long, start_line int, end_line int, text string")
    assert {(r["symbol"], r["comment"]) for r in C.attach_comments(calls, comments).collect()} == {("f", "late"), ("g", None)}


def java_hash(text, seed):
    for c in text:
        seed = (seed * 31 + ord(c)) % 2**32
    return seed


def test_minhash(spark):
    words = ["return", "abc", "value_of"]
    df = spark.createDataFrame([(words, words[:2], [])], "a array<string>, b array<string>, e array<string>")
    row = df.select(T.minhash_signature(F.col("a")).alias("s"), T.minhash_estimate(T.minhash_signature(F.col("a")), T.minhash_signature(F.col("b"))).alias("m"), T.string_hash(F.lit("abc")).alias("h")).first()
    want = [min(java_hash(w, i * 31337) for w in words) for i in range(64)]
    other = [min(java_hash(w, i * 31337) for w in words[:2]) for i in range(64)]
    assert row["h"] == 96354 and row["s"] == want and row["m"] == pytest.approx(sum(x == y for x, y in zip(want, other)) / 64)
    names = spark.createDataFrame([("myVar_x-y",)], "n string").select(T.identifier_words(F.col("n")).alias("w"), T.to_fixed(F.lit(2.345), 2).alias("t")).first()
    assert names["w"] == ["my", "Var", "x", "y"] and names["t"] == "2.35"
    sizes = spark.createDataFrame([(10, 10), (8, 10), (7, 10), (5, 10), (0, 10)], "a int, b int").select(T.most_jaccard(F.col("a"), F.col("b"), 0.7).alias("x"))
    assert [r["x"] for r in sizes.collect()] == [True, True, True, False, False]


def test_tests_are_judged(spark):
    rows = [("python", "test_add", "def test_add():\n    m = Mock()\n    assert add(1) == 2\n    self.assertTrue(x)\n", "a/test_x.py"), ("python", "test1", "def test_1(): pass", "a/test_x.py"), ("python", "helper", "def helper(): assert 1", "a/test_x.py"), ("java", "testSumsUpRows", "@Test public void testSumsUpRows() { assertThat(x); }", "src/test/A.java"), ("python", "test_out", "def test_out(): assert 1", "a/b.py")]
    e = spark.createDataFrame([(i, 1, lang, s, "function", name, src, 1, 3, None) for i, (lang, s, src, name) in enumerate(rows, 1)], SCHEMA)
    r = G.test_quality(e).first()
    assert (r["tests"], r["assertions"], r["mocks"], r["without_assertion"], r["numbered_names"], r["short_names"], r["odd_names"]) == (3, 4, 1, 1, 1, 2, 1)


def test_analyses_are_calculated_ahead(spark, tmp_path):
    from quarrygraph.plans import precalculate as A

    e = spark.createDataFrame([(i, 1 + i % 2, "python", f"load{i}", "function", "a.py", "def f(a):\n    if a:\n        return 1\n    return 2\n    x\n", 1, 6, None, "(a)", None) for i in range(6)], SCHEMA + ", parameters string, return_type string")
    calls = spark.createDataFrame([(1, 0, 2, 3)], "id long, caller long, callee long, line int")
    path = str(tmp_path / "cache")
    plans = A.parts(e, calls)
    assert [(n, err) for n, _, err in A.precalculate(spark, plans, path)] == [("complexity", None), ("duplication", None), ("dashboard", None), ("files", None)]
    assert {r["project_id"]: r["n"] for r in C.analysis_read(A.read_cache(spark, path, "duplication"), "duplication", "duplicated int").withColumnRenamed("duplicated", "n").collect()} == {1: 3, 2: 3}

    def broken():
        raise ValueError("no")

    again = A.precalculate(spark, {"dashboard": broken, "files": plans["files"]}, path)
    assert again[0][2] == "ValueError: no" and again[1][2] is None
    assert A.read_cache(spark, path, "dashboard").count() == 2 and A.read_cache(spark, path, "files").count() == 2


def test_bulk_insert_and_places(spark):
    old = spark.createDataFrame([(5, 1), (9, 2)], "id long, caller long")
    got = C.bulk_insert(old, spark.createDataFrame([(7,), (8,)], "caller long").repartition(2)).collect()
    ids = [r["id"] for r in got]
    assert len(set(ids)) == 4 and min(i for i in ids if i not in (5, 9)) > 9 and {r["caller"] for r in got} == {1, 2, 7, 8}
    e = spark.createDataFrame([(1, 1, "a.c", "outer", "function", 1, 20), (2, 1, "a.c", "inner", "function", 5, 9), (3, 1, "a.c", "T", "class", 5, 9)], "id long, project_id int, filename string, symbol string, type string, start_line int, end_line int")
    places = spark.createDataFrame([(1, "a.c", 6), (1, "a.c", 12), (1, "a.c", 30), (2, "a.c", 6)], "project_id int, filename string, line int")
    assert {(r["line"], r["function"]) for r in G.enclosing_functions(places, e).collect()} == {(6, "inner"), (12, "outer")}
