"""Source trees as tables: the walk of a folder, its exclusions, binary files and slices of texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: folders that no walk enters
EXCLUDED = ("node_modules", ".git", ".svn", ".hg", "vendor", "dist", "build", "__pycache__", ".pytest_cache", "target", ".next", ".nuxt", "coverage")
# fixed values: languages by extension; .h is C here, as in the tables
LANGUAGES = {
    "c": "c h", "cpp": "cpp hpp cc cxx hxx", "javascript": "js mjs jsx", "python": "py pyw", "java": "java", "csharp": "cs", "typescript": "ts mts", "tsx": "tsx",
    "rust": "rs", "swift": "swift", "ruby": "rb rake gemspec", "php": "php phtml php3 php4 php5 phps", "zig": "zig", "go": "go",
}


def ignore_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """(pattern of relative paths, whether it shuts out) of gitignore lines, in order; a line that begins with ! lets in again."""
    rules = []
    for raw in lines:
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        shuts = not line.startswith("!")
        line = line.lstrip("!").removeprefix("\\")
        folder, rooted = line.endswith("/"), "/" in line.rstrip("/")
        body = line.strip("/")
        out = ""
        for piece in re.split(r"(\*\*/|\*\*|\*|\?)", body):
            out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece, re.escape(piece))
        rules.append((("^" if rooted else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"), shuts))
    return rules


def ignore_regex(lines: list[str]) -> str | None:
    """One pattern for what the lines shut out, negations aside; None for no line."""
    return "|".join(pattern for pattern, shuts in ignore_rules(lines) if shuts) or None


def is_ignored(path: Column, lines: list[str]) -> Column:
    """Whether the lines shut a relative path out: the last line that matches decides."""
    out = F.lit(False)
    for pattern, shuts in ignore_rules(lines):
        out = F.when(path.rlike(pattern), F.lit(shuts)).otherwise(out)
    return out


def ignore_lines(spark: SparkSession, root: str) -> list[str]:
    """The lines of the ignore file in the root; none where there is no such file."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    stream = fs.open(place)  # Spark's own readers leave hidden files out
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


def language_column(filename: Column) -> Column:
    """The language of a file name's extension, c for any other."""
    ext = F.lower(F.regexp_extract(filename, r"\.([^./]*)$", 1))
    out = F.lit("c")
    for lang, exts in LANGUAGES.items():
        out = F.when(ext.isin(*exts.split()), lang).otherwise(out)
    return out


def is_binary(text: Column) -> Column:
    """A NUL anywhere, or more than a tenth of the first 8000 characters control characters other than white space."""
    head = F.substring(text, 1, 8000)
    odd = F.length(F.regexp_replace(head, r"[^\x00-\x08\x0E-\x1F]", ""))
    return (F.instr(text, "\0") > 0) | (odd > 0.1 * F.length(head))


def read_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), ignore: list[str] | None = None) -> DataFrame:
    """filename (relative to the root), language, source of all text files below the root that the root's ignore file and the
    lines of ``ignore`` let in. Files of other extensions are not read at all."""
    base = root.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        cased = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x.lstrip(".")) for x in extensions]
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(cased) + "}")
    df = reader.load(base)
    rel = F.regexp_replace("path", rf"^(?:file:)?/*{re.escape(base.lstrip('/'))}/", "")
    df = df.select(rel.alias("filename"), "content")
    df = df.filter(~F.col("filename").rlike("(?:^|/)(?:" + "|".join(re.escape(x) for x in EXCLUDED) + ")/"))
    if lines := ignore_lines(spark, base) + (ignore or []):
        df = df.filter(~is_ignored(F.col("filename"), lines))
    df = df.select("filename", language_column(F.col("filename")).alias("language"), F.decode("content", "UTF-8").alias("source"))
    return df.filter(~is_binary(F.col("source")))


def git_address(url: Column) -> Column:
    """The https form of a repository address; null where it is none."""
    ssh = F.regexp_replace(url, r"^(?:ssh://)?git@([^:/]+)[:/]", "https://$1/")
    return F.when(url.rlike(r"^(?:https?://|git@|ssh://|git://)"), F.regexp_replace(F.regexp_replace(ssh, r"^git://", "https://"), r"\.git$", ""))


def slice_text(text: Column, start_line: int, end_line: int, start_column: int | None = None, end_column: int | None = None) -> Column:
    """Lines start to end (from 1), the first from a column on and the last up to a column (from 0)."""
    lines = F.slice(F.split(text, "\n"), start_line, end_line - start_line + 1)
    n = F.size(lines)

    def one(x: Column, i: Column) -> Column:
        out = x
        if end_column is not None:
            out = F.when(i == n - 1, F.substring(x, 1, end_column)).otherwise(out)
        if start_column is not None:
            out = F.when(i == 0, out.substr(F.lit(start_column + 1), F.length(out))).otherwise(out)
        return out

    return F.array_join(F.transform(lines, one), "\n")
