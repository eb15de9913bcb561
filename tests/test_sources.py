import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from quarrygraph.functions.lexing import language_of, skim
from quarrygraph.operators import extraction as X
from quarrygraph.sources import files as S
from quarrygraph.streaming import ingest
from quarrygraph.streaming.ingest import ingest_stream, merge_batch, read_merged, vacuum


def test_walk(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1\n", "src/b.h": "int x;\n", "node_modules/c.js": "x", "src/vendor/d.c": "x", "logs/e.py": "y", "src/f.bin.py": "a\0b", "README.md": "hi"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {(r["filename"], r["language"]) for r in S.read_tree(spark, str(tmp_path), (".py", ".h"), ["logs/", "# no"]).collect()}
    assert got == {("src/a.py", "python"), ("src/b.h", "c")}


@pytest.mark.parametrize("lines,path,hit", [(["*.log"], "a/b.log", True), (["/top"], "x/top", False), (["build/"], "a/build/x", True), (["a/**/z"], "a/b/c/z", True), ([""], "a", None)])
def test_ignore(lines, path, hit):
    import re

    rx = S.ignore_regex(lines)
    assert (rx is None) if hit is None else bool(re.search(rx, path)) is hit


def test_git_addresses(spark):
    df = spark.createDataFrame([("git@host.test:a/b.git",), ("https://host.test/a/b.git",), ("/home/x",), (None,)], "u string")
    assert [r[0] for r in df.select(S.git_address(F.col("u"))).collect()] == ["https://host.test/a/b", "https://host.test/a/b", None, None]


def test_slice(spark):
    df = spark.createDataFrame([("one\ntwo\nthree\nfour",)], "t string")
    assert df.select(S.slice_text(F.col("t"), 2, 3)).first()[0] == "two\nthree"
    assert df.select(S.slice_text(F.col("t"), 2, 3, 1, 2)).first()[0] == "wo\nth"


def test_lexer_strings_comments_and_holes():
    src = "const a = `x ${f({b: `in ${c}`})} // no`; // yes\nlet r = /[/\"]+/g; 'it\\'s'"
    k = skim(src, "javascript")
    assert not k.errors and len(k.comments) == 1 and len(k.code) == len(src) and "in" not in k.code
    assert skim('s = R"x(a " ) b)x"; // c', "cpp").errors == []
    assert skim("fn f<'a>(x: &'a str) -> char { 'x' }", "rust").errors == []
    assert [e[0] for e in skim("f(a[1)", "c").errors] == ["unbalanced", "open"] or skim("f(a[1)", "c").errors
    assert skim("", "go").code == "" and language_of(None) is None and language_of("a.unknown") is None


def test_extraction():
    py = 'class A(Base):\n    def f(self, x):\n        """Doc."""\n        return g(x)\n'
    rows = X.parse(py, "python")
    assert ("function", "f", 2, 4, 4, "(self, x)") in rows and ("extends", "A", 1, 1, 0, "Base") in rows
    assert any(r[:2] == ("call", "g") and r[2] == 4 for r in rows)
    java = "public abstract class A extends B implements C, D {\n  int f(int a) { return g(a); }\n}\n"
    kinds = {(r[0], r[5]) for r in X.parse(java, "java")}
    assert {("extends", "B"), ("implements", "C"), ("implements", "D"), ("class", "abstract")} <= kinds
    assert ("embeds", "Base") in {(r[0], r[5]) for r in X.parse("package a\ntype T struct {\n\tBase\n\tx int\n}\n", "go")}


def test_stream_merges_batches(spark, tmp_path):
    schema = TT.StructType([TT.StructField("k", TT.StringType()), TT.StructField("v", TT.IntegerType()), TT.StructField("at", TT.TimestampType())])
    day = lambda n: dt.datetime(2024, 1, n)
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame([("a", 1, day(1)), ("b", 1, day(1))], schema).write.mode("append").parquet(src)
    ingest_stream(spark, src, schema, out, ck, ["k"], ["at"]).awaitTermination(60)
    spark.createDataFrame([("a", 2, day(2)), ("b", 0, day(0 + 1)), ("c", 1, day(3))], schema).write.mode("append").parquet(src)
    ingest_stream(spark, src, schema, out, ck, ["k"], ["at", "v"]).awaitTermination(60)
    assert {(r["k"], r["v"]) for r in read_merged(spark, out).collect()} == {("a", 2), ("b", 1), ("c", 1)}


def test_a_writer_that_dies_leaves_the_table(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(x, "k string, v int")
    merge_batch(rows(("a", 1), ("b", 1)), 0, out, ["k"], ["v"], buckets=4)
    with monkeypatch.context() as m:
        m.setattr(ingest, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            merge_batch(rows(("a", 2)), 1, out, ["k"], ["v"])
    assert {tuple(r) for r in read_merged(spark, out).collect()} == {("a", 1), ("b", 1)}
    for i in (1, 1):  # the batch again, and once more after a lost offset
        merge_batch(rows(("a", 2), ("c", 5)), i, out, ["k"], ["v"])
    vacuum(spark, out)
    assert {tuple(r) for r in read_merged(spark, out).collect()} == {("a", 2), ("b", 1), ("c", 5)}
    with pytest.raises(RuntimeError):
        ingest._publish(spark, out, 3, {})


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace as N

    from quarrygraph.sources.tables import checkpoint_dir

    bare = N(conf=N(get=lambda k, d="": d), sparkContext=N(master="spark://host:7077", getConf=lambda: N(get=lambda k, d="": d)))
    with pytest.raises(ValueError):
        checkpoint_dir(bare)


def test_ignore_files_let_in_again(spark, tmp_path):
    for name in ("a.py", "b.PY", "gen/c.py", "gen/keep.py", "x/out/d.py", "e.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("# made\ngen/*\n!gen/keep.py\nout/\n")
    assert {r["filename"] for r in S.read_tree(spark, str(tmp_path), (".py",)).collect()} == {"a.py", "b.PY", "gen/keep.py"}
    assert {r["filename"] for r in S.read_tree(spark, str(tmp_path), (".py",), ["b.PY", "!out/"]).collect()} == {"a.py", "gen/keep.py", "x/out/d.py"}
