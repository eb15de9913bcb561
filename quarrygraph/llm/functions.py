"""Problem 1: functions paired with their documentation.

``extract_functions`` finds every function and method of source files: the lexer of ``lexing`` blanks
comments and literals, a pattern of the language finds heads in what is left, matched braces (for
Python the indentation) delimit the body, and the documentation comment that ends right above the
head, or the string that opens a Python body, is attached. ``pair_entities`` runs the same walk over
entity rows, whose ``comment`` column is what stands right above their ``source``.
Pairs whose documentation is missing or says nothing are dropped by ``describes``.

Cases: a null or empty source, an unknown language or a null type give no pair; a null comment counts
as none; repeated rows give repeated pairs; whole texts are read, however long; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import language_of, walk_functions

_CODE_LANGUAGES = {"python", "javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust"}

# ---------------------------------------------------------------- does a documentation describe?

_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|//[/!]*|\*+(?![*\w])|\#+!?|--+(?=\s)|\"{3}|'{3}|<!--)?[ \t]*|[ \t]*(?:\*+/|\"{3}|'{3}|-->)?[ \t\r]*$")
_XML = re.compile(r"</?\s*(?:summary|remarks|para|returns|param|example|code|inheritdoc|exception|see|value|c|p|br|pre|b|i)\b[^>]*>", re.I)
_PARAM = re.compile(r"^(?:[@\\:](?:param|parameter|arg|argument|tparam|property|prop|raises|throws|exception|returns?|rtype|type|typeparam|yields?|template|memberof|since|version|author|deprecated|see|link|throws)\b[^\n]*|(?:args|arguments|parameters|params|returns?|raises|yields|throws|notes?|examples?)\s*:?)$", re.I)
_DASH_PARAM = re.compile(r"^`?[A-Za-z_$][\w$]*`?\s*(?:\([^)]*\))?\s*(?:-|--|:|–)\s+\S")
_SKIP = re.compile(
    r"^(?:"
    r"\W*(?:TODO|FIXME|XXX|HACK|BUG|TBD|WIP|REVIEW|OPTIMIZE|NOTE TO SELF)\b.*"
    r"|\W*(?:eslint|tslint|jslint|jshint|jscs|stylelint|prettier|biome|istanbul|c8|v8|nyc|pylint|flake8|mypy|pyright|ruff|isort|yapf|fmt|noqa|nosec|nolint\w*|nosonar|type\s*:\s*ignore|pragma|clang-format|clang-tidy|clang|cppcheck|coverage|rustfmt|clippy|gofmt|golint|go:\w+|lint|@ts-\w+|ts-\w+|@formatter|spotless|checkstyle|spotbugs|resharper|suppress\w*|@suppress\w*|swiftlint|codecov|webpack\w*|@jsx|@flow|region|endregion|#region|sonar|lcov_excl\w*|gcov\w*|exempt|black|autopep8|line too long|skipcq|deepcode|codeql|lgtm|semgrep)\b.*"
    r"|.*\b(?:copyright|spdx-license-identifier|all rights reserved|licen[sc]ed? (?:under|to|by|under the)|permission is hereby granted|without warrant|redistribution and use|licen[sc]e-?identifier|see (?:the )?licen[sc]e|mit licen[sc]e|apache licen[sc]e|gnu general public)\b.*"
    r"|\W*(?:@?\{?@?inherit-?doc\}?|non-?javadoc|@?overrides?|@?implements?|see (?:also )?(?:the )?(?:base|super|parent|interface|overridden)[\w ]*|inherited(?: from| documentation| doc)?[\w ]*|same as (?:base|parent|super)[\w ]*|documented in (?:base|parent|super|interface)[\w ]*|documentation inherited[\w ]*|@see\b.*|@copydoc\b.*|@internal|@private|@public|@protected|@api|@hidden|@ignore|@deprecated|@async|@static|@abstract|@virtual|@function|@method|@class|@constructor|@generated)\W*"
    r"|\W*(?:default (?:comment|doc\w*|description)(?: template)?|placeholder(?: comment| text| doc\w*| description)?|(?:add|insert|write|put|enter|your|some|a)?\s*(?:description|documentation|docstring|doc|docs|comment|comments|summary|text)(?: text)?(?: goes)?(?: here)?|(?:description|documentation|comment|summary) (?:missing|pending|needed|to be added|to follow|tbd|comes? later|coming soon)|to be (?:documented|described|written|done|added|defined|determined)(?: later)?|document (?:me|this)(?: later)?|(?:auto-?generated|generated)(?: method| function| constructor| comment| by \w+)?(?: stub| comment)?|undocumented|no (?:description|documentation|comment|docs?)(?: available| provided| yet| given)?|missing (?:description|documentation|doc\w*|comment)|lorem ipsum.*|blah(?: blah)*|foo bar.*|n/?a|none|null|nil|todo|tbd|test|temp|dummy|stub|empty|method stub|function (?:comment|description|documentation)|(?:description|documentation|summary|comment|purpose) (?:of|for) (?:the |this )?(?:method|function|class|procedure|module)|comment template|fill (?:me |this )?in(?: later)?|write (?:me|docs?|documentation|something)(?: here)?|coming soon|unused|documentation\s*\.\.\.|\.\.\.)\W*"
    r")$",
    re.I,
)
_CODE = re.compile(
    r"^(?:[\w.\[\]>-]+\s*(?:[-+*/%|&^]|<<|>>|:)?=(?!=)\s*[^;]*;?|(?:return|break|continue|throw|raise|goto|pass|yield|await)\b[^.!?]*;?|[\w.:>-]+\s*\([^)]*\)\s*;?|.*[;{}]|(?:if|for|while|switch|elif|else\s*if)\s*\(.*\)\s*\{?|(?:if|elif|for|while|def|class|with)\b[^.!?]*:|(?:let|const|var|int|long|double|float|auto|public|private|static|import|#include|using|fn|func|def)\s+[\w<>\[\]]+.*[;={(].*)$"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
_PLAIN_LEAD = re.compile(r"^(?:the|a|an|this|function|method|func|def|procedure|routine|fn)+|(?:function|method|func|procedure|routine|fn|definition|implementation|helper)+$")
_REST_WORDS = {"the", "a", "an", "this", "function", "method", "func", "def", "fn", "procedure", "routine", "constructor", "of", "class", "implementation"}


def _own_words(line: str, symbol: str) -> bool:
    """Whether the line says more than the words of the symbol."""
    mine = "".join(_CAMEL.findall(symbol or "")).lower()
    said = re.sub(r"[\W_]+", "", line).lower()
    if not said:
        return False
    if mine and (said == mine or said.replace(mine, "", 1) in ("", "the", "function", "thefunction", "method", "themethod", "func", "fn", "def", "this", "thisfunction", "a", "functionthe")):
        return False
    known = {w.lower() for w in _CAMEL.findall(symbol or "")} | _REST_WORDS
    return any(w not in known for w in (x.lower() for x in _WORD.findall(line)))


def doc_lines(doc: str) -> list[str]:
    """The documentation's lines without comment marks and markup."""
    out = []
    for line in doc.replace("\r", "\n").split("\n"):
        line = _MARKS.sub("", line)
        while (x := _MARKS.sub("", line)) != line:
            line = x
        out.append(_XML.sub(" ", line).strip() if "<" in line else line)
    return out


def describes(doc: str | None, symbol: str | None = "") -> bool:
    """Whether at least one sentence or phrase of the documentation says what the function does."""
    if not doc or not doc.strip():
        return False
    for line in doc_lines(doc):
        if not line:
            continue
        words = _WORD.findall(line)
        if not words:
            continue
        if _PARAM.match(line) or _DASH_PARAM.match(line) or _SKIP.match(line) or _CODE.match(line):
            continue
        if not _own_words(line, symbol or ""):
            continue
        core = re.sub(r"^[-=*#~_+.\s]+|[-=*#~_+\s]+$", "", line)
        ruler = core != line and (line[0] in "-=*#~_+" and line[-1] in "-=*#~_+")
        if ruler and len(words) < 3:
            continue
        if len(words) >= 3 or len(_CJK.findall(line)) >= 4:
            return True
        if len(words) == 2 and not ruler and all(len(w) > 1 for w in words):
            return True
    return False


# ---------------------------------------------------------------- pairs of files and of entities


def extract_functions(files: DataFrame, id_col: str = "id", filename_col: str = "filename", source_col: str = "source") -> DataFrame:
    """file_id, symbol, start_line, end_line, code, description: a row for each documented function of the files."""
    narrow = files.select(F.col(id_col).alias("file_id"), F.col(filename_col).alias("file_name"), F.col(source_col).alias("file_text")).filter(F.col("file_text").isNotNull())
    kind = dict(narrow.dtypes)["file_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, name, src in zip(f["file_id"], f["file_name"], f["file_text"]):
                lang = language_of(name)
                if lang not in _CODE_LANGUAGES:
                    continue
                for symbol, s, e, doc in walk_functions(src, lang):
                    if describes(doc, symbol):
                        first = src.count("\n", 0, s) + 1
                        rows.append((i, symbol, first, first + src.count("\n", s, e), src[s:e], "\n".join(x for x in doc_lines(doc)).strip()))
            yield pd.DataFrame(rows, columns=["file_id", "symbol", "start_line", "end_line", "code", "description"])

    return narrow.mapInPandas(run, f"file_id {kind}, symbol string, start_line int, end_line int, code string, description string")


def pair_entity(symbol: str | None, lang: str | None, source: str | None, comment: str | None) -> tuple[str, str] | None:
    """(code, documentation) of one entity row, or None where it is undocumented."""
    if not source or lang not in _CODE_LANGUAGES:
        return None
    stated = comment if describes(comment, symbol) else None
    if stated is None and (lang != "python" or "'" not in source and '"' not in source):
        return None  # nothing that the walk could attach
    unit = source
    first = None
    for name, s, e, doc in walk_functions(unit, lang):
        first = (name, s, e, doc)
        break
    if first is None:
        return (source, stated) if stated else None
    _, s, e, doc = first
    if stated is None and not describes(doc, symbol):
        return None
    return unit[:e] if s == 0 or not unit[:s].strip() else unit, stated or doc


def pair_entities(entities: DataFrame, id_col: str = "id") -> DataFrame:
    """entity_id, symbol, code, description of every entity row of type function whose documentation describes it."""
    narrow = entities.filter(F.col("type") == "function").select(F.col(id_col).alias("entity_id"), "symbol", "language", F.col("source").alias("code"), F.col("comment").alias("doc")).filter(F.col("code").isNotNull())
    kind = dict(narrow.dtypes)["entity_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, symbol, lang, source, comment in zip(f["entity_id"], f["symbol"], f["language"], f["code"], f["doc"]):
                if p := pair_entity(symbol, lang, source, comment):
                    rows.append((i, symbol, p[0], "\n".join(doc_lines(p[1])).strip()))
            yield pd.DataFrame(rows, columns=["entity_id", "symbol", "code", "description"])

    return narrow.mapInPandas(run, f"entity_id {kind}, symbol string, code string, description string")
