"""Problem 2: source files that do not parse.

Operator ``find_unparsable`` lexes every file with the lexer of the language its extension names and
runs a pushdown stack over the tokens: unterminated literals and comments, unbalanced brackets,
premature ends, merge-conflict markers, patches, and statements no rule of the language begins.

Cases: null and empty sources, unknown extensions and settings files other than .json give no row in
``find_unparsable``; a leading byte order mark is skipped; repeated rows are rows of their own; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import _PRE, Skim, language_of, skim

CHECKED = ("python", "javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust", "json")

_MARKERS = re.compile(r"^(?:<{7}(?: |$)|>{7}(?: |$)|={7}[ \t\r]*$|\|{7}(?: |$))", re.M)
_PATCH = re.compile(r"^(?:diff --git |@@ -\d|--- a/|\+\+\+ b/|Index: \S+$)", re.M)
_MARKUP = re.compile(r"\s*(?:<!DOCTYPE|<html|<\?xml)", re.I)

# fixed values: reserved and contextual words after or before which another word may stand
_PY_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type print exec"
_JS_WORDS = "as async await break case catch class const continue debugger default delete do else export extends false finally for from function get if import in instanceof let new null of return set static super switch this throw true try typeof undefined var void while with yield accessor using"
_TS_WORDS = _JS_WORDS + " abstract any asserts bigint boolean constructor declare enum global implements infer interface is keyof module namespace never number object out override package private protected public readonly require satisfies string symbol type unique unknown"


def _adjacent(words: str) -> re.Pattern:
    kw = "|".join(words.split())
    return re.compile(rf"(?<![\w.$@#])(?!(?:{kw})\b)[A-Za-z_$][\w$]*[ \t]+(?!(?:{kw})\b)[A-Za-z_$][\w$]*")


_ADJACENT = {"python": _adjacent(_PY_WORDS), "javascript": _adjacent(_JS_WORDS), "typescript": _adjacent(_TS_WORDS)}

# what can't stand in code of a language: constructs of the others
_FOREIGN = {
    "python": r"^[ \t]*(?:else\s*if|\}|//|/\*)|&&|\|\||\+\+[;)]|=>|:=[^=]*;$|::|^[ \t]*(?:import|from)[^\n]*;?\s*\"|^[ \t]*(?:using|package|use|fn|func|let|const|var|interface|namespace|struct|public|private|export)\s+\w|[{;]\s*$(?!\n[ \t]*[\"\w\d\]\[{}(])",
    "javascript": r"\b(?:let|const|var)\s+\w+\s*:\s*[\w<{\[(]|\)\s*:\s*[\w<>\[\], |]+\s*(?:\{|=>)|^[ \t]*(?:export\s+)?(?:declare\s+)?(?:interface|enum|namespace|type)\s+\w+\s*(?:<[^>\n]*>\s*)?(?:extends [\w, ]+)?[{=]|^[ \t]*(?:private|public|protected|readonly|abstract)\s+\w|\bimplements\s+\w|[(,]\s*\w+\??:\s*(?:number|string|boolean|any|void|unknown|Map<|Array<|Record<|\w+\[\])|\bas\s+(?:any|const|string|number)\b|::|^[ \t]*(?:package|using|def|fn|func|elif|impl|pub|use)\s+\w|:=|^[ \t]*#(?!!|[a-zA-Z_]\w*\s*(?:[(=;]|$))|^[ \t]*\"[^\n\"]*:",
    "typescript": r"::|^[ \t]*(?:package|using|def|fn|func|elif|impl|pub|use)\s+\w|:=|^[ \t]*#(?!!|[a-zA-Z_]\w*\s*(?:[(=;:]|$))",
    "java": r"::\w+::|^[ \t]*(?:using|use|def|fn|func|elif|impl|pub|let|var\s+\w+\s*:|namespace|from|export|const|type|struct|function)\s+\w|:=|=>|===|!==|^[ \t]*#|\bclass\s+\w+\s*:\s*\w|^[ \t]*public:|\bstd::|\blet mut\b|\)\s*:\s*\w+\s*\{",
    "csharp": r"^[ \t]*(?:package|import|use|def|fn|func|elif|impl|pub|let|from\s+\S+\s+import|export|type|function|extends)\s+\w|:=|===|!==|^[ \t]*#(?!\s*(?:if|else|elif|endif|define|undef|region|endregion|pragma|nullable|line|error|warning)\b)|\b(?:class|struct)\s+\w+\s+(?:extends|implements)\b|^[ \t]*public:|\bstd::|\blet mut\b",
    "c": r"::|^[ \t]*(?:package|import|using|use|def|fn|func|elif|impl|pub|let|var|from|export|function|namespace|template|interface|class|trait|public|private|protected|async)\b|:=|=>|===|!==|\bnew\s+\w+\s*[(\[]|\brequire\s*\(|\b(?:class|extends|implements)\s+\w|->\s*\w+\s*\{|^[ \t]*#(?!\s*(?:include|define|undef|if|ifdef|ifndef|else|elif|endif|pragma|error|warning|line)\b|\s*$)",
    "cpp": r"^[ \t]*(?:package|import\s+[\w.]+\.|use|def|fn|func|elif|impl|pub|let|var|from|export\s+(?:class|function|const|interface)|function|interface|trait)\s+\w|:=|=>|===|!==|\brequire\s*\(|\b(?:extends|implements)\s+\w|^[ \t]*#(?!\s*(?:include|define|undef|if|ifdef|ifndef|else|elif|endif|pragma|error|warning|line|import)\b|\s*$)|^[ \t]*(?:public|private|protected)\s+(?:static\s+)?(?:class|final|int|long|void|double|string|String)\b|\blet mut\b",
    "go": r"^[ \t]*(?:public|private|class|def|fn|use|using|let|export|function|impl|pub|from|#include)\b|=>|===|!==|::|^[ \t]*#|\bwhile\s*\(|\belse\s*\n",
    "rust": r"^[ \t]*(?:package|import|using|def|func|elif|from|export|function|class|public|private|var|namespace|interface|const\s+\w+\s*=|int|long|double|void)\b|:=|===|!==|^[ \t]*#(?!!?\[)|\bnew\s+\w+\(|\bstd::cout|\bfor\s+(?!.*\bin\b)[^\n]*\{|\bfor\s*\(\s*int\b|\+\+|\bstatic\s+(?:int|void|double)\b",
}
_FOREIGN = {k: re.compile(v, re.M) for k, v in _FOREIGN.items()}

# what a file must begin with, where the language's grammar says so
_BEGIN = {
    "go": re.compile(r"\s*package\s+\w+[ \t]*(?:;|\r?\n|\Z)"),
    "java": re.compile(r"\s*(?:;|@|(?:package|import|public|protected|private|abstract|final|class|interface|enum|record|sealed|non-sealed|strictfp|static|module|open)\b|\Z)"),
    "csharp": re.compile(r"\s*(?:;|\[|#|(?:using|namespace|extern|global|public|protected|private|internal|abstract|sealed|static|partial|class|struct|interface|enum|record|readonly|ref|unsafe|delegate|file|async|var|await|return|if|for|foreach|while|int|long|string|bool|double|void|Console)\b|\Z)"),
    "rust": re.compile(r"\s*(?:#|;|(?:use|mod|pub|fn|struct|enum|impl|trait|const|static|extern|type|unsafe|async|macro_rules|union|crate)\b|\w+!|\Z)"),
}
_SEMI = {"java", "c", "cpp", "csharp", "rust"}
_OPEN_END = re.compile(r"(?:[=+\-*/%<>&|^,.(\[?~]|\b(?:return|import|from|extends|implements|class|function|def|const|let|var|new|in|of|and|or|not|if|elif|while|for|else|interface|type|func|package|struct|fn|use|pub|impl|public|private|static|export|default|async))\Z")
_JS_END_OK = re.compile(r"(?:\+\+|--|\breturn|/[a-z]*|\bdefault)\Z")
# a line of a language with semicolons that ends in a word although the next begins with one
_NO_SEMI = re.compile(r"^[ \t]*(?!#)(?!(?:public|private|protected|else|do|try|case|default|template|static|inline|extern|const|finally|unsafe|async|pub|where|abstract|final|override|virtual|new)\b)\w[^\n]*[\w)\]\"][ \t\r]*\n[ \t]*(?!(?:const|throws|where|noexcept|override|final|else|extends|implements|as|is|and|or|instanceof|in)\b)[A-Za-z_]\w*[ \t]*(?:[\w(.;=*]|\+=|-=)", re.M)
_PY_BLOCK = re.compile(r"(?:async\s+)?(?:def|class|if|elif|else|for|while|try|except|finally|with)\b")
_PY_CONTINUE = re.compile(r"(?:elif|else|except|finally)\b")


def _python_lines(code: str) -> bool:
    """Whether the logical lines' indentation and block heads fit together. code: without comments and text."""
    depth, stack, want, text = 0, [0], False, ""
    for line in code.split("\n"):
        body = line.strip()
        if not body:
            continue
        if not depth and not text:
            flat = line.expandtabs(8)
            width = len(flat) - len(flat.lstrip(" \f﻿"))
            if want:
                if width <= stack[-1]:
                    return False
                stack.append(width)
            elif width > stack[-1]:
                return False
            else:
                while width < stack[-1]:
                    stack.pop()
                if width != stack[-1]:
                    return False
            want = False
        if "(" in body or "[" in body or "{" in body or ")" in body or "]" in body or "}" in body:
            for o, c in ("()", "[]", "{}"):
                depth += body.count(o) - body.count(c)
        text = f"{text} {body}" if text else body
        if depth <= 0 and body[-1] != "\\":
            depth = 0
            if _PY_BLOCK.match(text):
                if text[-1] == ":":
                    want = True
                elif ":" not in text:
                    return False
            elif text[-1] == ":" and not text.startswith(("match ", "case ")):
                return False
            elif text[-1] == ":":
                want = True
            if _OPEN_END.search(text) and not text.endswith(("...", "return", "*")):
                return False
            text = ""
    return not want and not text


_JSON = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)|([{}\[\],:]))')


def json_valid(src: str) -> bool:
    """Strict JSON by a pushdown automaton over its tokens."""
    stack: list[str] = []
    state, pos, n = "value", 0, len(src.rstrip(" \t\n\r"))
    while pos < n:
        m = _JSON.match(src, pos)
        if not m:
            return False
        pos = m.end()
        text, mark = m[1], m[3]
        if mark is None:
            if state in ("value", "first"):
                state = "after"
            elif text is not None and state in ("key", "firstkey"):
                state = "colon"
            else:
                return False
        elif mark in "{[":
            if state not in ("value", "first"):
                return False
            stack.append(mark)
            state = "firstkey" if mark == "{" else "first"
        elif mark == "}":
            if not stack or stack[-1] != "{" or state not in ("after", "firstkey"):
                return False
            stack.pop()
            state = "after"
        elif mark == "]":
            if not stack or stack[-1] != "[" or state not in ("after", "first"):
                return False
            stack.pop()
            state = "after"
        elif mark == ":":
            if state != "colon":
                return False
            state = "value"
        else:
            if state != "after" or not stack:
                return False
            state = "key" if stack[-1] == "{" else "value"
    return state == "after" and not stack


def problem_of(src: str | None, lang: str | None, walked: Skim | None = None) -> str | None:
    """What keeps the text from being parsed in the language, or None. walked: the text's walk, if it has been made."""
    if not src or lang not in CHECKED:
        return None
    src = src.removeprefix("﻿")
    if not src.strip():
        return "empty document" if lang == "json" and src else None
    if lang == "json":
        return None if json_valid(src) else "merge conflict" if _MARKERS.search(src) else "invalid json"
    if _MARKUP.match(src):
        return "markup"
    k = walked or skim(src, lang)
    code = k.code
    if _MARKERS.search(code):
        return "merge conflict"
    if _PATCH.search(code):
        return "patch"
    if k.errors:
        kind = k.errors[0][0]
        return {"unterminated": "unterminated literal", "comment": "unterminated comment", "open": "unclosed bracket"}.get(kind, "unbalanced bracket")
    if lang in ("c", "cpp", "csharp"):
        plain = _PRE.sub("", code) if "#" in code else code
    else:
        plain = code
    if lang in _BEGIN and not _BEGIN[lang].match(code):
        return "no beginning of the language"
    if lang in _ADJACENT and (m := _ADJACENT[lang].search(code)):
        return "words without an operator"
    if _FOREIGN[lang].search(code):
        return "construct of another language"
    end = plain.rstrip()
    if lang in _SEMI:
        if end and end[-1] not in ";}" and not (lang == "cpp" and end[-1] == ":") and not end.endswith("]"):
            return "premature end"
        if _NO_SEMI.search(plain):
            return "statement without an end"
    elif lang == "python":
        if not _python_lines(code):
            return "indentation or block head"
    elif end and _OPEN_END.search(end) and not _JS_END_OK.search(end):
        return "premature end"
    return None


def flag_files(files: DataFrame, id_col: str = "id", filename_col: str = "filename", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per file of a checked language with text: id, language, problem (null if it parses) and the ``keep`` columns."""
    narrow = files.select(F.col(id_col).alias("file_id"), F.col(filename_col).alias("file_name"), F.col(source_col).alias("file_text"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    narrow = narrow.filter(F.col("file_text").isNotNull() & (F.col("file_text") != ""))
    types = dict(narrow.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            langs = [language_of(x) for x in f["file_name"]]
            f["language"] = langs
            f["problem"] = [problem_of(s, g) for s, g in zip(f["file_text"], langs)]
            f = f[f["language"].isin(CHECKED)]
            yield f.drop(columns=["file_name", "file_text"])

    schema = ", ".join([f"file_id {types['file_id']}"] + [f"kept_{i} {types[f'kept_{i}']}" for i in range(len(keep))] + ["language string", "problem string"])
    out = narrow.mapInPandas(run, schema)
    return out.select(F.col("file_id").alias(id_col), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], "language", "problem")


def find_unparsable(files: DataFrame, **names) -> DataFrame:
    """The rows of ``flag_files`` with a problem."""
    return flag_files(files, **names).filter(F.col("problem").isNotNull())


def unparsable_rates(files: DataFrame, project_col: str = "project_id", **names) -> DataFrame:
    """project, language, files, broken, rate over all files of a checked language with text; a null project is a group of its own."""
    flags = flag_files(files, keep=(project_col,), **names)
    return flags.groupBy(project_col, "language").agg(F.count("*").alias("files"), F.count("problem").alias("broken")).withColumn("rate", F.col("broken") / F.col("files"))
