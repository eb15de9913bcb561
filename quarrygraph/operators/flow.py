"""Control-flow graphs of functions in twelve languages.

A function's body is read into a tree of statements: for Python by its own parser, for the others by a recursive walk over
the lexed code, in which comments are blank and literals are quotes, so brackets and keywords are those of the
code. The graph is then built from the tree, the same way for every language. Edges are labelled Yes and No behind a
decision, Loop and Done behind a loop, by its label behind a case, and ``exception`` from a try to its handlers;
return and throw end their path, break and continue go to the loop or switch they leave or repeat.

Cases: null and empty sources and unknown languages give no rows; what can't be parsed as a statement is one process
node; a Python file that its parser refuses gives none; labels have fifty characters at most, the rest three dots.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import Skim, functions_in, language_of, skim

BRACES = ("javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust", "php", "swift", "zig")
_WORD = re.compile(r"[A-Za-z_]\w*!?")
_LOOPS = {"for", "while", "foreach", "loop", "repeat"}
_SWITCHES = {"switch", "match", "select"}
_ENDS_PATH = {"return", "throw", "raise"}
_JUMPS = _ENDS_PATH | {"break", "continue", "goto"}
_GOES_ON = re.compile(r"[-+*/%=&|^<>!?:,.(\[]\s*\Z")
_LABEL = re.compile(r"(?:case\b[^:]*?(?:::[^:]*?)*|default\s*)(?::(?!:)|->|=>)")
_ZIG_HEAD = re.compile(r"\s*(?::\s*\([^{}]*?\))?\s*(?:\|[^|\n]*\|)?")  # what a loop goes on by, and what it catches
_NEEDS_NO_SEMICOLON = ("go", "javascript", "typescript", "swift")


@dataclass
class Statement:
    """kind: if, loop, switch, case, try, catch, finally, block, jump or plain; parts are the statements within, other those
    of the else branch, the handlers or the cases."""

    kind: str
    begin: int
    end: int
    head: str = ""
    parts: list = field(default_factory=list)
    other: list | None = None


class _Reader:
    """Statements of brace languages, by place in the code."""

    def __init__(self, src: str, k: Skim, lang: str):
        self.src, self.code, self.closing, self.lang = src, k.code, k.closing, lang

    def skip(self, i: int, end: int) -> int:
        while i < end and (self.code[i].isspace() or self.code[i] == ";"):
            i += 1
        return i

    def text(self, a: int, b: int) -> str:
        return re.sub(r"\s+", " ", self.src[a:b]).strip()

    def header(self, i: int, end: int) -> tuple[int, int]:
        """(end of the header that begins at i, begin of the body)."""
        i = self.skip(i, end)
        if i < end and self.code[i] == "(" and self.lang not in ("go", "rust", "swift"):
            close = self.closing.get(i, end - 1) + 1
            if self.lang == "zig" and (m := _ZIG_HEAD.match(self.code, close, end)):
                close = m.end()
            return close, close
        at = i
        while at < end and self.code[at] != "{":
            at = self.closing.get(at, at) + 1 if self.code[at] in "([" else at + 1
        return at, at

    def branch(self, i: int, end: int) -> tuple[list, int]:
        """The statements of a body, a block or a single statement, and where it ends."""
        i = self.skip(i, end) if i < end and self.code[i] != ";" else i
        if i >= end or self.code[i] == ";":
            return [], min(i + 1, end)
        if self.code[i] == "{":
            close = self.closing.get(i, end)
            return self.statements(i + 1, min(close, end)), close + 1
        one, at = self.statement(i, end)
        return [one], at

    def statements(self, i: int, end: int) -> list[Statement]:
        out = []
        while (i := self.skip(i, end)) < end:
            one, at = self.statement(i, end)
            out.append(one)
            i = max(at, i + 1)
        return out

    def word(self, i: int, end: int) -> str:
        m = _WORD.match(self.code, i, end)
        return m[0] if m else ""

    def statement(self, i: int, end: int) -> tuple[Statement, int]:
        code, w = self.code, self.word(i, end)
        if code[i] == "{":
            parts, at = self.branch(i, end)
            return Statement("block", i, at, "", parts), at
        if w == "if":
            head, body = self.header(i + 2, end)
            parts, at = self.branch(body, end)
            nxt, other = self.skip(at, end), None
            if self.word(nxt, end) == "else":
                other, at = self.branch(nxt + 4, end)
            return Statement("if", i, at, self.text(i, head), parts, other), at
        if w in _LOOPS or w == "do" and self.skip(i + 2, end) < end and code[self.skip(i + 2, end)] == "{":
            if w == "do":
                parts, at = self.branch(i + 2, end)
                nxt = self.skip(at, end)
                head = "do"
                if self.word(nxt, end) == "while":
                    at = self.header(nxt + 5, end)[0]
                    head = self.text(nxt, at)
                return Statement("loop", i, at, head, parts), at
            head, body = self.header(i + len(w), end)
            parts, at = self.branch(body, end)
            return Statement("loop", i, at, self.text(i, head), parts), at
        if w in _SWITCHES:
            head, body = self.header(i + len(w), end)
            at = self.skip(body, end)
            if at < end and code[at] == "{":
                close = min(self.closing.get(at, end), end)
                return Statement("switch", i, close + 1, self.text(i, head), [], self.cases(at + 1, close)), close + 1
        if w == "try":
            at = self.skip(i + 3, end)
            if at < end and code[at] == "(":
                at = self.closing.get(at, end - 1) + 1
            parts, at = self.branch(at, end)
            handlers = []
            while (nxt := self.skip(at, end)) < end and self.word(nxt, end) in ("catch", "finally"):
                word = self.word(nxt, end)
                opened = self.skip(nxt + len(word), end)
                head = nxt + len(word)
                if word == "catch" and opened < end and code[opened] == "(":
                    head = self.closing.get(opened, end - 1) + 1
                inner, at = self.branch(head, end)
                handlers.append(Statement(word, nxt, at, self.text(nxt, head), inner))
            return Statement("try", i, at, "try", parts, handlers), at
        at = self.plain_end(i, end)
        if w in _JUMPS:
            return Statement("jump", i, at, self.text(i, at).rstrip(";"), [w]), at
        # a block with a head of its own, such as a lock, a label or a resource
        opened = self.opens(i, end)
        if opened is not None:
            parts, at = self.branch(opened, end)
            return Statement("block", i, at, self.text(i, opened), parts), at
        return Statement("plain", i, at, self.text(i, at).rstrip(";")), at

    def opens(self, i: int, end: int) -> int | None:
        """Where the block of a statement like ``lock (x) {`` begins; None where it is none."""
        at = i
        while at < end and self.code[at] not in "{;\n=":
            at = self.closing.get(at, at) + 1 if self.code[at] in "([" else at + 1
        at = self.skip(at, end) if at < end and self.code[at] == "\n" else at
        head = self.code[i:at].strip()
        return at if at < end and self.code[at] == "{" and re.fullmatch(r"(?:lock|using|synchronized|unsafe|fixed|checked|unchecked|async|defer|static|[A-Za-z_]\w*:)\s*(?:move)?\s*(?:\(.*\))?", head, re.S) else None

    def plain_end(self, i: int, end: int) -> int:
        at, code = i, self.code
        while at < end:
            ch = code[at]
            if ch in "([{":
                at = self.closing.get(at, end - 1) + 1
                continue
            if ch == ";":
                return at + 1
            if ch in ")]}":
                return at if at > i else at + 1
            if ch == "\n" and self.lang in _NEEDS_NO_SEMICOLON and not _GOES_ON.search(code[max(i, at - 20) : at]) and not re.match(r"\s*[.?+*/&|]", code[at : at + 40]):
                return at
            at += 1
        return end

    def cases(self, i: int, end: int) -> list[Statement]:
        if self.lang in ("rust", "zig"):
            return self.arms(i, end)
        marks, at = [], i
        while at < end:
            if self.code[at] in "([{":
                at = self.closing.get(at, end) + 1
            elif (m := _LABEL.match(self.code, at, end)) and (at == 0 or not self.code[at - 1].isalnum()):
                marks.append((at, m.end(), m[0]))
                at = m.end()
            else:
                at += 1
        out = []
        for n, (s, e, head) in enumerate(marks):
            stop = marks[n + 1][0] if n + 1 < len(marks) else end
            # the empty case falls through to the next one, as all do that do not jump, but in Go and behind an arrow
            out.append(Statement("case", s, stop, re.sub(r"\s*(?::|->|=>)\Z", "", self.text(s, e)), self.statements(e, stop), [] if self.lang in ("go", "swift") or head.endswith((">",)) else None))
        return out

    def arms(self, i: int, end: int) -> list[Statement]:
        out = []
        while (i := self.skip(i, end)) < end:
            arrow = self.code.find("=>", i, end)
            if arrow < 0:
                break
            at = self.skip(arrow + 2, end)
            if at < end and self.code[at] == "{":
                parts, stop = self.branch(at, end)
            else:
                stop = at
                while stop < end and self.code[stop] != ",":
                    stop = self.closing.get(stop, stop) + 1 if self.code[stop] in "([{" else stop + 1
                parts = self.statements(at, stop)
            out.append(Statement("case", i, stop, self.text(i, arrow), parts, []))
            i = stop
            while i < end and (self.code[i].isspace() or self.code[i] == ","):
                i += 1
        return out


def _python(body: list, place, src: str) -> list[Statement]:
    """The tree of Python statements; place gives the character of a line and column."""
    out = []
    for st in body:
        a, b = place(st.lineno, st.col_offset), place(st.end_lineno, st.end_col_offset)
        first = src[a:b].split("\n")[0].strip()
        inner = lambda x: _python(x, place, src)
        if isinstance(st, ast.If):
            out.append(Statement("if", a, b, first.rstrip(":"), inner(st.body), inner(st.orelse) if st.orelse else None))
        elif isinstance(st, (ast.For, ast.AsyncFor, ast.While)):
            out.append(Statement("loop", a, b, first.rstrip(":"), inner(st.body), inner(st.orelse) if st.orelse else None))
        elif isinstance(st, ast.Match):
            cases = [Statement("case", place(c.pattern.lineno, c.pattern.col_offset), place(c.body[-1].end_lineno, c.body[-1].end_col_offset), "case " + ast.unparse(c.pattern), inner(c.body), []) for c in st.cases]
            out.append(Statement("switch", a, b, first.rstrip(":"), [], cases))
        elif isinstance(st, (ast.Return, ast.Raise, ast.Break, ast.Continue)):
            out.append(Statement("jump", a, b, first, [type(st).__name__.lower()]))
        elif isinstance(st, (ast.Try, ast.TryStar)):
            handlers = [Statement("catch", place(h.lineno, h.col_offset), place(h.end_lineno, h.end_col_offset), src[place(h.lineno, h.col_offset) :].split("\n")[0].strip().rstrip(":"), inner(h.body)) for h in st.handlers]
            if st.finalbody:
                f = st.finalbody
                handlers.append(Statement("finally", place(f[0].lineno, f[0].col_offset), place(f[-1].end_lineno, f[-1].end_col_offset), "finally", inner(f)))
            out.append(Statement("try", a, b, "try", inner(st.body) + (inner(st.orelse) if st.orelse else []), handlers))
        elif isinstance(st, (ast.With, ast.AsyncWith)):
            out.append(Statement("block", a, b, first.rstrip(":"), inner(st.body)))
        else:
            out.append(Statement("plain", a, b, first))
    return out


def shorten(label: str, most: int = 50) -> str:
    return label if len(label) <= most else label[: most - 3] + "..."


class Graph:
    """nodes: (number, type, label, begin, end); edges: (from, to, label). Loose ends are (node, label) of edges to come."""

    def __init__(self):
        self.nodes: list[tuple] = [(0, "start", "Start", None, None)]
        self.edges: list[tuple[int, int, str]] = []

    def add(self, kind: str, label: str, s: Statement | None, ends: list) -> int:
        n = len(self.nodes)
        self.nodes.append((n, kind, shorten(label), s.begin if s else None, s.end if s else None))
        self.edges += [(a, n, text) for a, text in ends]
        return n

    def run(self, statements: list[Statement]) -> Graph:
        self.returns: list = []
        ends = self.block(statements, [(0, "")], None, None)
        self.add("end", "End", None, ends + self.returns)
        return self

    def levels(self) -> list[int]:
        """The longest way from the start to each node, edges back aside; they alone lead to a node of no greater number."""
        out = [0] * len(self.nodes)
        for a, b, _ in sorted(self.edges, key=lambda e: e[1]):
            if a < b:
                out[b] = max(out[b], out[a] + 1)
        return out

    def block(self, statements: list, ends: list, loop: tuple | None, breaks: list | None) -> list:
        for s in statements:
            if not ends:
                break  # nothing gets here
            ends = self.one(s, ends, loop, breaks)
        return ends

    def one(self, s: Statement, ends: list, loop: tuple | None, breaks: list | None) -> list:
        if s.kind == "block":
            if s.head:
                ends = [(self.add("process", s.head, s, ends), "")]
            return self.block(s.parts, ends, loop, breaks)
        if s.kind == "if":
            n = self.add("decision", s.head, s, ends)
            yes = self.block(s.parts, [(n, "Yes")], loop, breaks)
            return yes + (self.block(s.other, [(n, "No")], loop, breaks) if s.other is not None else [(n, "No")])
        if s.kind == "loop":
            n, left = self.add("loop", s.head, s, ends), []
            back = self.block(s.parts, [(n, "Loop")], (n,), left)
            self.edges += [(a, n, text) for a, text in back]
            done = [(n, "Done")]
            return (self.block(s.other, done, loop, breaks) if s.other else done) + left
        if s.kind == "switch":
            n, left, fall, named = self.add("decision", s.head, s, ends), [], [], False
            for c in s.other or []:
                named = named or c.head in ("default", "_", "case _")
                out = self.block(c.parts, [(n, c.head), *fall], loop, left)
                fall, left = (out, left) if c.other is None else ([], left + out)
            return left + fall + ([] if named and (left or fall) else [(n, "")] if not named else [])
        if s.kind == "jump":
            word = s.parts[0]
            n = self.add("return" if word == "return" else "process", s.head or word, s, ends)
            if word == "return":
                self.returns.append((n, ""))
            elif word == "break" and breaks is not None:
                breaks.append((n, ""))
            elif word == "continue" and loop:
                self.edges.append((n, loop[0], ""))
            elif word not in ("throw", "raise"):
                return [(n, "")]
            return []
        if s.kind == "try":
            n = self.add("process", "try", s, ends)
            out = self.block(s.parts, [(n, "")], loop, breaks)
            for h in s.other or []:
                if h.kind == "catch":
                    c = self.add("process", h.head, h, [(n, "exception")])
                    out += self.block(h.parts, [(c, "")], loop, breaks)
                else:
                    f = self.add("process", "finally", h, out or [(n, "")])
                    out = self.block(h.parts, [(f, "")], loop, breaks)
            return out
        if len(s.head) < 2:
            return ends
        return [(self.add("process", s.head, s, ends), "")]


def graphs_of(src: str, lang: str) -> Iterator[tuple[str, int, int, Graph]]:
    """(function, begin, end, graph) of every function of the text."""
    if lang == "python":
        src = src.removeprefix("﻿")
        try:
            tree = ast.parse(src)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        lines = src.split("\n")
        starts = [0]
        for x in lines:
            starts.append(starts[-1] + len(x) + 1)

        def place(line: int, column: int) -> int:
            text = lines[line - 1]
            return starts[line - 1] + (column if text.isascii() else len(text.encode()[:column].decode("utf-8", "ignore")))

        for fn in ast.walk(tree):
            if isinstance(fn, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield fn.name, place(fn.lineno, fn.col_offset), place(fn.end_lineno, fn.end_col_offset), Graph().run(_python(fn.body, place, src))
        return
    if lang not in BRACES:
        return
    k = skim(src, lang)
    reader = _Reader(src, k, lang)
    for name, begin, end, _ in functions_in(src, lang, k):
        op = k.code.find("(", begin)
        brace = k.code.find("{", k.closing.get(op, op), end) if op >= 0 else -1
        if brace < 0:
            continue
        try:
            yield name, begin, end, Graph().run(reader.statements(brace + 1, k.closing.get(brace, end)))
        except RecursionError:
            continue


NODES = "file_id {}, function string, start_line int, node int, level int, type string, label string, line int, end_line int, snippet string"
EDGES = "file_id {}, function string, start_line int, from_node int, to_node int, label string"


def control_flow(files: DataFrame, id_col: str = "id", filename_col: str = "filename", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the functions of all files; a function is told by file, name and first line, a node by its number
    within. The level is a node's longest way from the start, the snippet the first line of its text."""
    narrow = files.select(F.col(id_col).alias("file_id"), F.col(filename_col).alias("file_name"), F.col(source_col).alias("file_text")).filter("file_text IS NOT NULL AND file_text <> ''")
    kind = dict(narrow.dtypes)["file_id"]

    def rows(want_nodes: bool, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in (NODES if want_nodes else EDGES).split(", ")]
        for f in frames:
            out = []
            for i, name, src in zip(f["file_id"], f["file_name"], f["file_text"]):
                lang = language_of(name)
                for function, begin, _, g in graphs_of(src, lang) if lang else ():
                    text = src.removeprefix("﻿") if lang == "python" else src
                    line = lambda p: None if p is None else text.count("\n", 0, p) + 1
                    first = line(begin)
                    if want_nodes:
                        level = g.levels()
                        out += [(i, function, first, n, level[n], t, label, line(a), line(max(a, b - 1)) if a is not None else None, text[a:b].split("\n")[0].strip() if a is not None else None) for n, t, label, a, b in g.nodes]
                    else:
                        out += [(i, function, first, *e) for e in g.edges]
            yield pd.DataFrame(out, columns=columns).astype({"line": "Int32", "end_line": "Int32"} if want_nodes else {})

    return narrow.mapInPandas(lambda x: rows(True, x), NODES.format(kind)), narrow.mapInPandas(lambda x: rows(False, x), EDGES.format(kind))
