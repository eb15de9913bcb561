"""Functions, classes, calls, inheritance, identifiers and comments out of source files, and entity rows made of them.

One walk of the lexer blanks comments and literals; patterns of the language then find heads in what is left, and
matched brackets (for Python the indentation) give extents. This is an approximation of a parser, made once a file
and distributed over files.

Cases: null and empty sources and unknown languages give no rows; repeated files give repeated rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.lexing import functions_in, indented_end, language_of, skim

CODE = {"python", "javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust", "ruby", "php", "swift", "zig"}
_CLASS = {
    "python": re.compile(r"^[ \t]*class[ \t]+(?P<n>\w+)[ \t]*(?:\((?P<base>[^)]*)\))?[ \t]*:", re.M),
    "java": re.compile(r"\b(?P<abs>abstract\s+)?(?:final\s+)?(?P<kind>class|interface)\s+(?P<n>\w+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<base>[\w.<>, ]+?))?(?:\s+implements\s+(?P<impl>[\w.<>, ]+?))?\s*\{"),
    "cpp": re.compile(r"\b(?P<kind>class|struct)\s+(?P<n>\w+)\s*(?:final\s*)?(?::\s*(?P<base>[\w:<>, ]+?))?\s*\{"),
    "csharp": re.compile(r"\b(?P<abs>abstract\s+)?(?P<kind>class|struct|interface)\s+(?P<n>\w+)(?:<[^{]*?>)?\s*(?::\s*(?P<base>[\w.<>, ]+?))?\s*\{"),
    "go": re.compile(r"\btype\s+(?P<n>\w+)\s+(?P<kind>struct)\s*\{"),
    "rust": re.compile(r"\b(?P<kind>struct)\s+(?P<n>\w+)[^;{(]*\{"),
    "c": re.compile(r"\b(?P<kind>struct)\s+(?P<n>\w+)\s*\{"),
}
_CLASS |= {
    "ruby": re.compile(r"^[ \t]*(?:class|module)[ \t]+(?P<n>[A-Z]\w*(?:::\w+)*)(?:[ \t]*<[ \t]*(?P<base>[\w:]+))?", re.M),
    "php": re.compile(r"\b(?P<abs>abstract\s+)?(?:final\s+)?(?P<kind>class|interface|trait)\s+(?P<n>\w+)(?:\s+extends\s+(?P<base>[\w\\, ]+?))?(?:\s+implements\s+(?P<impl>[\w\\, ]+?))?\s*\{"),
    "swift": re.compile(r"\b(?P<kind>class|struct|protocol)\s+(?P<n>[A-Z]\w*)(?:<[^{]*?>)?\s*(?::\s*(?P<base>[\w.<>, ]+?))?\s*\{"),
    "zig": re.compile(r"\bconst\s+(?P<n>\w+)\s*=\s*(?:extern\s+|packed\s+)?(?P<kind>struct)\s*\{"),
}
_CLASS |= {"javascript": _CLASS["java"], "typescript": _CLASS["java"]}
_CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)\s*\(")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*")
_NO_CALL = set("if for while switch catch return function def class elif with and or not in is lambda func fn new sizeof typeof await async print_ else do match except".split())


def _names(text: str | None) -> list[str]:
    out = []
    for part in (text or "").split(","):
        words = [w for w in re.findall(r"[\w.:]+", re.sub(r"<[^>]*>", "", part)) if w not in ("public", "private", "protected", "virtual")]
        if words and "=" not in part:
            out.append(words[-1].split(".")[-1].split("::")[-1])
    return out


KINDS = ("function", "comment", "class", "struct", "interface", "extends", "implements", "embeds", "call", "identifier", "block")
_CLASSES = {"class", "struct", "interface", "extends", "implements", "embeds"}
# fixed values: words before a type that are no part of it
_MODIFIERS = set("public private protected internal static final abstract virtual override sealed async native synchronized default unsafe partial extern new strictfp transient".split())
# fixed values: words that are no identifiers, by and large the same in all nine languages
KEYWORDS = set("if else for while do switch case default break continue return goto try catch finally throw throws raise except with as import from export package namespace using include define class struct interface enum trait impl extends implements type typedef union public private protected internal static final const let var func function def fn lambda async await yield new delete this self super null nil none None True False true false void int long short char float double bool boolean string unsigned signed byte in is not and or pass del global nonlocal mut pub mod use crate match loop where move ref dyn unsafe extern virtual override sealed abstract readonly volatile register inline sizeof typeof instanceof of go defer chan map range select fallthrough auto template typename operator friend".split())


def return_type(src: str, code: str, begin: int, name: str, close: int, lang: str) -> str:
    """What a function returns, as its head says it: a type where the language states one, else what kind of function it is."""
    if lang == "python":
        m = re.compile(r"\s*->\s*([^:\n]+(?:\[[^\]]*\])?)\s*:").match(src, close + 1)
        return m[1].strip() if m else "def"
    if lang in ("javascript", "typescript"):
        if lang == "typescript" and (m := re.compile(r"\s*:\s*(\{[^}]*\}|[^{=;\n]+)").match(src, close + 1)):
            return m[1].strip()
        if re.compile(r"\s*(?::[^={]+)?=>").match(code, close + 1):
            return "arrow_function"
        return "function" if re.search(r"\bfunction\b", code[begin:close]) else "method"
    if lang == "ruby":
        return "def"
    if lang in ("php", "swift", "zig"):
        m = re.compile(r"\s*(?:throws\s*)?(?::|->)?\s*([?!\w\[\]<>.\\ ]*?)\s*\{").match(code, close + 1)
        return m[1].strip() if m and m[1].strip() else "function" if lang == "php" else "void"
    if lang == "go":
        m = re.compile(r"\s*([A-Za-z_]\w*)\s*\{").match(code, close + 1)
        return m[1] if m else "void"
    if lang == "rust":
        m = re.compile(r"\s*->\s*([A-Za-z_]\w*)\s*(?:where\b|\{)").match(code, close + 1)
        return m[1] if m else "void"
    head = re.sub(r"@\w+(?:\([^)]*\))?", " ", code[begin : code.rfind(name, begin, close)])
    if lang in ("java", "csharp"):
        words = [w for w in re.sub(r"^\s*<[^>]*>", "", " ".join(w for w in head.split() if w not in _MODIFIERS)).split()]
        return re.sub(r"\s*([<>,\[\]?])\s*", lambda m: m[1] if m[1] != "," else ", ", " ".join(words)).strip() or name
    words = re.findall(r"[A-Za-z_][\w:]*(?:<[^>]*>)?", re.sub(r"\b\w+::\s*$|~$", "", head.rstrip()))
    return " ".join(w for w in words if not w.endswith("::") and w not in ("inline", "virtual", "explicit", "constexpr")) or "void"


def parse(src: str, lang: str, kinds: tuple[str, ...] = ()) -> list[tuple]:
    """(kind, symbol, start_line, end_line, column, detail) rows of one file; only what the kinds need is looked for."""
    want = set(kinds or KINDS)
    k = skim(src, lang)
    code, closing = k.code, k.closing
    starts = [0, *(m.end() for m in re.finditer("\n", src))]

    def at(pos: int) -> tuple[int, int]:
        line = bisect_right(starts, pos)
        return line, pos - starts[line - 1]

    rows: list[tuple] = []
    defined = set()
    if want & {"function", "comment", "call"}:
        for name, s, e, doc in functions_in(src, lang, k):
            op = code.find("(", s)
            close = closing.get(op)
            line, col = at(s)
            if "function" in want:
                rows.append(("function", name, line, at(max(s, e - 1))[0], col, re.sub(r"\s+", " ", src[op : close + 1]) if op >= 0 and close else ""))
            if doc and "comment" in want:
                rows.append(("comment", name, line, line, col, doc))
            defined.add(code.rfind(name, s, op if op >= 0 else None))
    if "block" in want:
        rows += [("block", "", at(s)[0], at(max(s, e - 1))[0], at(s)[1], src[s:e]) for s, e in k.in_order]
    if want & _CLASSES:
        rows += [r for r in _classes(src, code, closing, lang, at) if r[0] in want]
    if "call" in want:
        for m in _CALL.finditer(code):
            name = re.split(r"\.|::|->", m[1])[-1]
            if name not in _NO_CALL and m.start(1) not in defined and not re.search(r"\b(?:def|func|fn|function|class)\s+$", code[max(0, m.start() - 12) : m.start()]):
                line, col = at(m.start())
                rows.append(("call", name, line, line, col, m[1]))
    if "identifier" in want:
        for m in _IDENT.finditer(code):
            if m[0] not in KEYWORDS:
                line, col = at(m.start())
                rows.append(("identifier", m[0], line, line, col, _role(code, m)))
    return rows


def _role(code: str, m: re.Match) -> str:
    """definition, call, member, type or variable, and whether the place writes it."""
    before, after = code[max(0, m.start() - 24) : m.start()], code[m.end() : m.end() + 8]
    if re.search(r"\b(?:def|fn|func|function|class|struct|interface|trait|enum)\s+$", before):
        return "definition"
    write = re.match(r"\s*(?:[-+*/%|&^]|:)?=(?![=>])", after) is not None or re.search(r"\b(?:let|const|var|auto)\s+(?:mut\s+)?$", before) is not None
    if re.match(r"\s*\(", after):
        return "call"
    member = re.search(r"(?:\.|->|::)\s*$", before) is not None
    kind = "member" if member else "type" if m[0][:1].isupper() and not m[0].isupper() else "variable"
    return kind + (" write" if write else " read")


def _classes(src: str, code: str, closing: dict, lang: str, at) -> list[tuple]:
    rows: list[tuple] = []
    for m in _CLASS[lang].finditer(code):
        g = m.groupdict()
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        brace = code.find("{", m.end() - 1) if lang not in ("python", "ruby") else -1
        line, col = at(begin)
        end = at(closing[brace])[0] if brace in closing else at(max(begin, indented_end(code, begin, m.end() - 1) - 1))[0] if lang in ("python", "ruby") else line
        if lang == "ruby" and end < len(lines := code.split("\n")) and lines[end].strip() == "end":
            end += 1
        rows.append((g.get("kind") or "class", g["n"], line, end, col, "abstract" if g.get("abs") else ""))
        rows += [("extends", g["n"], line, line, col, b) for b in _names(g.get("base"))]
        rows += [("implements", g["n"], line, line, col, b) for b in _names(g.get("impl"))]
    if lang == "go":  # a line of a struct that is one name only embeds it
        for m in _CLASS["go"].finditer(code):
            body = code[m.end() : closing.get(m.end() - 1, m.end())]
            rows += [("embeds", m["n"], at(m.start())[0], at(m.start())[0], 0, x) for x in re.findall(r"^\s*\*?([A-Z]\w*)\s*$", body, re.M)]
    if lang == "rust":  # impl Trait for Type
        for m in re.finditer(r"\bimpl(?:<[^>]*>)?\s+([\w:]+)(?:<[^{]*?>)?\s+for\s+(\w+)", code):
            rows.append(("implements", m[2], at(m.start())[0], at(m.start())[0], at(m.start())[1], m[1].split("::")[-1]))
    return rows


def entity_rows(src: str, lang: str) -> list[tuple]:
    """(symbol, type, source, start_line, end_line, parameters, comment, return_type) of the functions, classes and structs."""
    k = skim(src, lang)
    code, closing = k.code, k.closing
    starts = [0, *(m.end() for m in re.finditer("\n", src))]
    at = lambda pos: (bisect_right(starts, pos), pos - starts[bisect_right(starts, pos) - 1])
    above = {at(max(s, e - 1))[0]: src[s:e] for s, e in k.in_order}
    out = []
    for name, s, e, _ in functions_in(src, lang, k):
        op = code.find("(", s)
        close = closing.get(op, op)
        line = at(s)[0]
        params = re.sub(r"\s+", " ", src[op : close + 1]) if op >= 0 else ""
        out.append((name, "function", src[s:e], line, at(max(s, e - 1))[0], params, above.get(line - 1), return_type(src, code, s, name, close, lang)))
    for kind, name, line, end, _, _ in _classes(src, code, closing, lang, at):
        if kind in ("class", "struct"):
            text = src[starts[line - 1] : starts[end] if end < len(starts) else len(src)].rstrip("\n").lstrip(" \t")
            out.append((name, kind, text, line, end, None, above.get(line - 1), None))
    return out


def assemble_entities(files: DataFrame) -> DataFrame:
    """Entity rows of all files (id, project_id, filename, source): file_id, project_id, language, symbol, type, filename,
    source, start_line, end_line, parameters, comment, return_type. The comment is the one that ends on the line above."""
    narrow = files.select("id", "project_id", "filename", "source").filter("source IS NOT NULL AND source <> ''")
    kinds = dict(narrow.dtypes)
    columns = ["file_id", "project_id", "language", "symbol", "type", "filename", "source", "start_line", "end_line", "parameters", "comment", "return_type"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, project, name, src in zip(f["id"], f["project_id"], f["filename"], f["source"]):
                lang = language_of(name)
                if lang in CODE:
                    rows += [(i, project, lang, r[0], r[1], name, *r[2:]) for r in entity_rows(src, lang)]
            yield pd.DataFrame(rows, columns=columns)

    return narrow.mapInPandas(run, f"file_id {kinds['id']}, project_id {kinds['project_id']}, language string, symbol string, type string, filename string, source string, start_line int, end_line int, parameters string, comment string, return_type string")


def extract(files: DataFrame, id_col: str = "id", filename_col: str = "filename", source_col: str = "source", kinds: tuple[str, ...] = ()) -> DataFrame:
    """file_id, kind, symbol, start_line, end_line, column_start, detail of all files; only the ``kinds`` named, if any."""
    narrow = files.selectExpr(f"`{id_col}` AS file_id", f"`{filename_col}` AS file_name", f"`{source_col}` AS file_text").filter("file_text IS NOT NULL")
    id_type = dict(narrow.dtypes)["file_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, name, src in zip(f["file_id"], f["file_name"], f["file_text"]):
                lang = language_of(name)
                if lang in CODE and src:
                    rows += [(i, *r) for r in parse(src, lang, kinds) if not kinds or r[0] in kinds]
            yield pd.DataFrame(rows, columns=["file_id", "kind", "symbol", "start_line", "end_line", "column_start", "detail"])

    return narrow.mapInPandas(run, f"file_id {id_type}, kind string, symbol string, start_line int, end_line int, column_start int, detail string")
