import pytest

from quarrygraph.functions.lexing import skim
from quarrygraph.operators import extraction as X
from quarrygraph.operators import flow as W


def graph(src, lang):
    (name, _, _, g), *_ = W.graphs_of(src, lang)
    label = {n: text for n, _, text, _, _ in g.nodes}
    return g, {(label[a], label[b], text) for a, b, text in g.edges}


C_LIKE = {
    "c": "int f(int a) {\n  if (a > 1) {\n    return 1;\n  } else {\n    g(a);\n  }\n  return 2;\n}\n",
    "java": "class A {\n  int f(int a) {\n  if (a > 1) {\n    return 1;\n  } else {\n    g(a);\n  }\n  return 2;\n}\n}\n",
    "csharp": "class A {\n  public int f(int a) {\n  if (a > 1) {\n    return 1;\n  } else {\n    g(a);\n  }\n  return 2;\n}\n}\n",
    "javascript": "function f(a) {\n  if (a > 1) {\n    return 1\n  } else {\n    g(a)\n  }\n  return 2\n}\n",
    "typescript": "function f(a: number): number {\n  if (a > 1) {\n    return 1;\n  } else {\n    g(a);\n  }\n  return 2;\n}\n",
    "cpp": "int f(int a) {\n  if (a > 1)\n    return 1;\n  else\n    g(a);\n  return 2;\n}\n",
}


@pytest.mark.parametrize("lang", C_LIKE)
def test_decisions(lang):
    g, edges = graph(C_LIKE[lang], lang)
    assert edges == {("Start", "if (a > 1)", ""), ("if (a > 1)", "return 1", "Yes"), ("if (a > 1)", "g(a)", "No"), ("g(a)", "return 2", ""), ("return 1", "End", ""), ("return 2", "End", "")}
    assert [t for _, t, *_ in g.nodes] == ["start", "decision", "return", "process", "return", "end"]


def test_go_and_rust_and_python_decide():
    _, go = graph("package a\n\nfunc f(a int) int {\n\tif err := g(); err != nil {\n\t\treturn 1\n\t} else if a > 2 {\n\t\th()\n\t}\n\treturn 2\n}\n", "go")
    assert {("if err := g(); err != nil", "return 1", "Yes"), ("if err := g(); err != nil", "if a > 2", "No"), ("if a > 2", "h()", "Yes"), ("if a > 2", "return 2", "No"), ("h()", "return 2", "")} <= go
    _, rust = graph("fn f(a: i32) -> i32 {\n    if let Some(x) = g(a) {\n        return x;\n    }\n    loop {\n        if a > 3 { break; }\n        step();\n    }\n    2\n}\n", "rust")
    assert {("if let Some(x) = g(a)", "return x", "Yes"), ("if let Some(x) = g(a)", "loop", "No"), ("loop", "if a > 3", "Loop"), ("if a > 3", "break", "Yes"), ("step()", "loop", "")} <= rust
    _, py = graph("def f(a):\n    if a:\n        return 1\n    for x in a:\n        if x:\n            break\n    return 2\n", "python")
    assert {("Start", "if a", ""), ("if a", "return 1", "Yes"), ("if a", "for x in a:".rstrip(":"), "No"), ("if x", "break", "Yes"), ("break", "return 2", ""), ("for x in a", "return 2", "Done"), ("if x", "for x in a", "No")} <= py
    assert list(W.graphs_of("def (", "python")) == [] and list(W.graphs_of("x", "cobol")) == []


def test_loops_and_jumps():
    _, edges = graph("void f(int n) {\n  for (int i = 0; i < n; i++) {\n    if (i == 2) continue;\n    if (i == 5) break;\n    work(i);\n  }\n  do { n--; } while (n > 0);\n  while (n) n--;\n}\n", "c")
    loop = "for (int i = 0; i < n; i++)"
    assert {(loop, "if (i == 2)", "Loop"), ("continue", loop, ""), ("if (i == 5)", "work(i)", "No"), ("work(i)", loop, ""), (loop, "while (n > 0)", "Done"), ("break", "while (n > 0)", ""), ("while (n > 0)", "n--", "Loop"), ("while (n)", "End", "Done")} <= edges


def test_switches():
    _, c = graph('void f(int n) {\n  switch (n) {\n    case 1: a(); break;\n    case 2:\n    case 3: b();\n    default: d();\n  }\n  e();\n}\n', "c")
    assert {("switch (n)", "a()", "case 1"), ("break", "e()", ""), ("switch (n)", "b()", "case 3"), ("switch (n)", "b()", "case 2"), ("b()", "d()", ""), ("switch (n)", "d()", "default"), ("d()", "e()", "")} <= c
    assert ("switch (n)", "e()", "") not in c
    _, go = graph("func f(n int) {\n\tswitch n {\n\tcase 1:\n\t\ta()\n\tcase 2:\n\t\tb()\n\t}\n\te()\n}\n", "go")
    assert {("switch n", "a()", "case 1"), ("a()", "e()", ""), ("switch n", "b()", "case 2"), ("switch n", "e()", "")} <= go and ("a()", "b()", "") not in go
    _, rust = graph("fn f(n: u8) {\n    match n {\n        1 => a(),\n        2 | 3 => { b(); }\n        _ => return,\n    }\n    e();\n}\n", "rust")
    assert {("match n", "a()", "1"), ("match n", "b()", "2 | 3"), ("match n", "return", "_"), ("a()", "e()", ""), ("b()", "e()", ""), ("return", "End", "")} <= rust
    _, java = graph("class A {\n  void f(int n) {\n    switch (n) {\n      case 1 -> a();\n      default -> b();\n    }\n  }\n}\n", "java")
    assert {("switch (n)", "a()", "case 1"), ("switch (n)", "b()", "default"), ("a()", "End", "")} <= java and ("a()", "b()", "") not in java
    _, py = graph("def f(n):\n    match n:\n        case 1:\n            a()\n        case _:\n            b()\n    e()\n", "python")
    assert {("match n", "a()", "case 1"), ("match n", "b()", "case _"), ("a()", "e()", "")} <= py and ("match n", "e()", "") not in py


def test_exceptions():
    _, js = graph("function f() {\n  try {\n    a();\n  } catch (e) {\n    b();\n    throw e;\n  } finally {\n    c();\n  }\n  d();\n}\n", "javascript")
    assert {("try", "a()", ""), ("try", "catch (e)", "exception"), ("catch (e)", "b()", ""), ("a()", "finally", ""), ("finally", "c()", ""), ("c()", "d()", "")} <= js
    assert not any(a == "throw e" for a, _, _ in js)
    _, py = graph("def f():\n    try:\n        a()\n    except ValueError as e:\n        raise\n    finally:\n        c()\n", "python")
    assert {("try", "except ValueError as e", "exception"), ("except ValueError as e", "raise", ""), ("a()", "finally", "")} <= py


MORE = [
    ("php", "<?php\nclass A extends B implements C {\n  // adds\n  public function add(int $a): int {\n    if ($a > 1) {\n      return 1;\n    }\n    foreach ($xs as $x) {\n      g($x);\n    }\n    return 2;\n  }\n}\n", "add", "int", (4, 12), "A", "// adds"),
    ("swift", "class A: B {\n    /// adds\n    func add(_ a: Int) -> Int {\n        if a > 1 {\n            return 1\n        }\n        for x in xs {\n            g(x)\n        }\n        return 2\n    }\n}\n", "add", "Int", (3, 11), "A", "/// adds"),
    ("zig", "const A = struct {\n    /// adds\n    pub fn add(a: i32) i32 {\n        if (a > 1) {\n            return 1;\n        }\n        for (xs) |x| {\n            g(x);\n        }\n        return 2;\n    }\n};\n", "add", "i32", (3, 11), "A", "/// adds"),
    ("ruby", "class A < B\n  # adds\n  def add(a)\n    if a > 1\n      return 1\n    end\n    2\n  end\n\n  def self.size\n    3\n  end\nend\n", "add", "def", (3, 8), "A", "# adds"),
]


@pytest.mark.parametrize("lang,src,name,kind,lines,cls,doc", MORE)
def test_four_more_languages(lang, src, name, kind, lines, cls, doc):
    rows = {r[0]: r for r in X.entity_rows(src, lang)}
    add = rows[name]
    assert (add[7], (add[3], add[4]), add[6]) == (kind, lines, doc)
    found = X.parse(src, lang)
    assert (cls in {r[1] for r in found if r[0] in ("class", "struct")}) and (lang == "zig" or ("extends", cls, "B") in {(r[0], r[1], r[5]) for r in found})
    if lang == "ruby":
        assert [r for r in found if r[0] == "class"][0][2:4] == (1, 13) and rows["size"][3:5] == (10, 12)
        return
    _, edges = graph(src, lang)
    test = {"php": "if ($a > 1)", "swift": "if a > 1", "zig": "if (a > 1)"}[lang]
    assert (test, "return 1", "Yes") in edges and ("return 2", "End", "") in edges and any(c == "Done" and b == "return 2" for _, b, c in edges)


def test_levels():
    g, _ = graph("void f(int n) {\n  while (n) {\n    if (n > 2) {\n      a();\n      b();\n    }\n    n--;\n  }\n}\n", "c")
    assert {label: level for (_, _, label, *_), level in zip(g.nodes, g.levels())} == {"Start": 0, "while (n)": 1, "if (n > 2)": 2, "a()": 3, "b()": 4, "n--": 5, "End": 2}


def test_labels_and_odd_bodies():
    long = "value = " + " + ".join(["part"] * 30)
    g, _ = graph(f"void f() {{\n  {long};\n}}\n", "c")
    assert len(g.nodes[1][2]) == 50 and g.nodes[1][2].endswith("...")
    assert [t for _, t, *_ in graph("void f() {}\n", "c")[0].nodes] == ["start", "end"]
    _, js = graph("function f() {\n  const x = items.map((i) => {\n    return i;\n  });\n  go(x)\n    .then(done)\n  end()\n}\n", "javascript")
    assert ("Start", "const x = items.map((i) => { return i; })", "") in js and ("go(x) .then(done)", "end()", "") in js
    _, cs = graph("class A {\n  void f() {\n    lock (o) {\n      a();\n    }\n    b();\n  }\n}\n", "csharp")
    assert {("Start", "lock (o)", ""), ("lock (o)", "a()", ""), ("a()", "b()", "")} <= cs
    assert graph("void f() {\n  if (a { b(); \n", "c") if list(W.graphs_of("void f() {\n  if (a { b(); \n", "c")) else True


RETURNS = [
    ("c", "unsigned int get_count(void) { return 1; }", "unsigned int"), ("c", "long long big(void) { return 1; }", "long long"), ("c", "struct node *get_node(int a) { return 0; }", "struct node"),
    ("c", "const char *text(void) { return 0; }", "const char"), ("c", "char *text(void) { return 0; }", "char"), ("c", "size_t size(void) { return 0; }", "size_t"), ("c", "void nothing(void) { }", "void"),
    ("java", "class A {\n  public static List<Integer> f(int a) { return null; }\n}", "List<Integer>"), ("java", "class A {\n  private int[] f() { return null; }\n}", "int[]"), ("csharp", "class A {\n  public async Task<int> F() { return 1; }\n}", "Task<int>"),
    ("python", "def f(a) -> list[int]:\n    return a\n", "list[int]"), ("python", "def f(a):\n    return a\n", "def"), ("javascript", "function f(a) { return a; }", "function"), ("javascript", "const f = (a) => { return a; };", "arrow_function"),
    ("typescript", "function f(a: number): Promise<string> { return a; }", "Promise<string>"), ("go", "func f(a int) error {\n\treturn nil\n}", "error"), ("go", "func f(a int) {\n}", "void"), ("rust", "fn f(a: i32) -> i32 {\n    a\n}", "i32"), ("rust", "fn f() {}\n", "void"),
]


@pytest.mark.parametrize("lang,src,want", RETURNS)
def test_return_types(lang, src, want):
    assert [r[7] for r in X.entity_rows(src, lang) if r[1] == "function"] == [want]


def test_entities_are_assembled(spark):
    src = "/* adds\n * two */\nint add(int a,\n        int b) {\n  return a + b;\n}\n\nstruct pair {\n  int a;\n};\n"
    files = spark.createDataFrame([(1, 7, "a.c", src), (2, 7, "a.c", None), (3, 7, "a.txt", "x"), (4, None, "b.py", "")], "id long, project_id int, filename string, source string")
    rows = {r["symbol"]: r for r in X.assemble_entities(files).collect()}
    assert set(rows) == {"add", "pair"}
    add = rows["add"]
    assert (add["file_id"], add["project_id"], add["language"], add["type"], add["start_line"], add["end_line"], add["return_type"]) == (1, 7, "c", "function", 3, 6, "int")
    assert add["parameters"] == "(int a, int b)" and add["comment"] == "/* adds\n * two */" and add["source"].startswith("int add(") and add["source"].endswith("}")
    assert (rows["pair"]["type"], rows["pair"]["start_line"], rows["pair"]["end_line"], rows["pair"]["source"]) == ("struct", 8, 10, "struct pair {\n  int a;\n};")


def test_only_the_kinds_asked_for():
    src = "class A extends B {\n  run(x) { this.y = load(x); }\n}\n"
    assert {r[0] for r in X.parse(src, "javascript", ("call",))} == {"call"}
    roles = {r[1]: r[5] for r in X.parse(src, "javascript", ("identifier",))}
    assert roles["y"] == "member write" and roles["load"] == "call" and "class" not in roles and "this" not in roles
    assert ("implements", "Point", "Shape") in {(r[0], r[1], r[5]) for r in X.parse("impl Shape for Point { }\n", "rust")}
    assert [(r[2], r[3]) for r in X.parse("// a\n/* b\n c */\nx = 1\n", "c", ("block",))] == [(1, 1), (2, 3)]


def test_flow_tables(spark):
    files = spark.createDataFrame([(1, "a.c", C_LIKE["c"]), (2, "a.c", None), (3, "x.py", "def (")], "id long, filename string, source string")
    nodes, edges = W.control_flow(files)
    rows = nodes.orderBy("node").collect()
    assert [r["type"] for r in rows] == ["start", "decision", "return", "process", "return", "end"] and rows[1]["line"] == 2 and rows[1]["end_line"] == 6 and rows[1]["snippet"] == "if (a > 1) {" and rows[0]["line"] is None
    assert edges.count() == 6 and {r["label"] for r in edges.collect()} == {"", "Yes", "No"}


def test_a_large_file_is_walked_in_linear_time():
    import time

    body = "".join(f"# about {i}\ndef f{i}(a):\n    '''Says {i}.'''\n    return a\n\n" for i in range(1000))
    took = []
    for n in (1, 4):
        t = time.process_time()
        list(X.parse(body * n, "python"))
        took.append(time.process_time() - t)
    assert took[1] < 9 * took[0] + 0.5 and len(skim(body, "python").comments) == 1000
