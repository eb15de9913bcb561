"""String- and comment-aware lexing of thirteen languages, by one compiled pattern a language.

``skim(source, language)`` walks the text once from token to token and returns the comments and
string literals with their places, what is wrong with literals and brackets, and the code with
comments and literals blanked out, so that patterns over the code never see text inside them.
The walk is a pushdown automaton: brackets (and, for JavaScript, template holes) are pushed and
popped, everything between two interesting characters is skipped by the pattern.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

EXTENSION_LANGUAGE = {
    "py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "go": "go", "rs": "rust", "json": "json",
    "rb": "ruby", "rake": "ruby", "php": "php", "phtml": "php", "swift": "swift", "zig": "zig",
    "env": "env", "yaml": "yaml", "yml": "yaml", "properties": "properties", "toml": "toml", "sh": "sh",
}

_DQ = r'"(?:[^"\\\n]|\\[\s\S])*(?:"|(?P<bad>\n|\Z))'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*(?:'|(?P<bad2>\n|\Z))"
_LINE = r"//[^\n]*"
_BLOCK = r"/\*[\s\S]*?(?:\*/|(?P<badc>\Z))"
_BRACKET = r"[()\[\]{}]"

_PATTERNS = {
    "python": rf"(?P<c>\#[^\n]*)|(?P<t>\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*(?:\"\"\"|(?P<badt>\Z))|'''(?:[^\\']|\\[\s\S]|'(?!''))*(?:'''|(?P<badt2>\Z)))|(?P<s>{_DQ}|{_SQ})|(?P<b>{_BRACKET})",
    "c": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>{_DQ}|{_SQ})|(?P<b>{_BRACKET})",
    "cpp": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<t>R\"(?P<d>[^()\\\s]{{0,16}})\([\s\S]*?(?:\)(?P=d)\"|(?P<badt>\Z)))|(?P<s>{_DQ}|(?<![0-9a-fA-F]){_SQ})|(?P<b>{_BRACKET})",
    "java": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<t>\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*(?:\"\"\"|(?P<badt>\Z)))|(?P<s>{_DQ}|{_SQ})|(?P<b>{_BRACKET})",
    "csharp": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<t>\"\"\"(?:[^\"]|\"(?!\"\"))*(?:\"\"\"|(?P<badt>\Z))|(?:@\$?|\$@)\"(?:[^\"]|\"\")*(?:\"|(?P<badt2>\Z)))|(?P<s>{_DQ}|{_SQ})|(?P<b>{_BRACKET})",
    "go": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<t>`[^`]*(?:`|(?P<badt>\Z)))|(?P<s>{_DQ}|{_SQ})|(?P<b>{_BRACKET})",
    "rust": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<t>r(?P<d>\#*)\"[\s\S]*?(?:\"(?P=d)|(?P<badt>\Z))|b?\"(?:[^\"\\]|\\[\s\S])*(?:\"|(?P<badt2>\Z)))|(?P<l>'[A-Za-z_]\w*(?!'))|(?P<s>{_SQ})|(?P<b>{_BRACKET})",
    "javascript": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<t>`)|(?P<s>{_DQ}|{_SQ})|(?P<b>{_BRACKET})|(?P<r>/)",
    "php": rf"(?P<c>{_LINE}|\#(?!\[)[^\n]*|{_BLOCK})|(?P<s>\"(?:[^\"\\]|\\[\s\S])*(?:\"|(?P<bad>\Z))|'(?:[^'\\]|\\[\s\S])*(?:'|(?P<bad2>\Z)))|(?P<b>{_BRACKET})",
    "swift": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<t>\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*(?:\"\"\"|(?P<badt>\Z)))|(?P<s>{_DQ})|(?P<b>{_BRACKET})",
    "zig": rf"(?P<c>{_LINE})|(?P<t>\\\\[^\n]*)|(?P<s>{_DQ}|{_SQ})|(?P<b>{_BRACKET})",
    "ruby": rf"(?P<c>(?:(?<=\s)|^)\#[^\n]*|^=begin\b[\s\S]*?(?:^=end\b|(?P<badc>\Z)))|(?P<s>\"(?:[^\"\\]|\\[\s\S])*(?:\"|(?P<bad>\Z))|'(?:[^'\\]|\\[\s\S])*(?:'|(?P<bad2>\Z)))|(?P<b>{_BRACKET})",
    # settings files: a hash comment only after a blank or at a line's start; quotes end with the line
    "settings": r"(?P<c>(?:(?<=\s)|^)[\#;][^\n]*)|(?P<s>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<b>[{}\[\]])",
}
_PATTERNS["typescript"] = _PATTERNS["javascript"]
_RX = {k: re.compile(v, re.M if k in ("settings", "ruby") else 0) for k, v in _PATTERNS.items()}
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?P<end>`|\$\{|\Z)")
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?:(?:^|[(,=:\[!&|?{};+\-*%~^<>])|\b(?:return|typeof|case|in|of|delete|void|throw|new))\s*\Z")
_CLOSES = {")": "(", "]": "[", "}": "{"}
_PRE = re.compile(r"^[ \t]*#[^\n\\]*(?:\\\r?\n[^\n\\]*)*", re.M)


@dataclass
class Skim:
    """comments and strings: (start, end) without order between the lists; code: the text with both blanked."""

    comments: list = field(default_factory=list)
    strings: list = field(default_factory=list)
    errors: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (open, close) places of matched brackets
    code: str = ""

    @cached_property
    def closing(self) -> dict[int, int]:
        """The place of each open bracket's match."""
        return dict(self.pairs)

    @cached_property
    def string_ends(self) -> dict[int, int]:
        return dict(self.strings)

    @cached_property
    def in_order(self) -> list[tuple[int, int]]:
        """The comments by place."""
        return sorted(self.comments)


def language_of(filename: str | None) -> str | None:
    """The language a file name's extension stands for; None for null, none or an unknown one."""
    if not filename:
        return None
    base = filename.replace("\\", "/").rsplit("/", 1)[-1]
    return EXTENSION_LANGUAGE.get(base.rsplit(".", 1)[-1].lower()) if "." in base else None


def _blank(text: str) -> str:
    return "\n".join(" " * len(x) for x in text.split("\n")) if "\n" in text else " " * len(text)


def skim(src: str, lang: str, want_code: bool = True) -> Skim:
    """One walk over the whole text. Empty text gives an empty result."""
    out = Skim()
    js = lang in ("javascript", "typescript")
    rx = _RX.get(lang) or _RX["settings"]
    stack: list = []  # (bracket, place); "`" marks a template hole
    parts: list = []
    pos = last = 0
    comments, strings, errors, pairs = out.comments, out.strings, out.errors, out.pairs
    search = rx.search
    line_bound = lang != "settings"

    def template(start: int, at: int) -> int:
        """From inside a template to its end or next hole; returns where the walk goes on."""
        m = _TEMPLATE.match(src, at)
        end = m["end"]
        strings.append((start, m.end()))
        if want_code:
            parts.append(src[last:start])
            parts.append('"' + _blank(src[start + 1 : m.end()]))
        if end == "${":
            stack.append(("`", m.end()))
        elif not end:
            errors.append(("unterminated", start))
        return m.end()

    while m := search(src, pos):
        kind, s, e = m.lastgroup, m.start(), m.end()
        if kind == "b" or (kind is None):
            ch = src[s]
            pos = e
            if ch in "([{":
                stack.append((ch, s))
            elif stack and stack[-1][0] == _CLOSES[ch]:
                pairs.append((stack.pop()[1], s))
            elif ch == "}" and stack and stack[-1][0] == "`":
                stack.pop()
                pos = template(s, e)
                last = pos
            else:
                errors.append(("unbalanced", s))
                if stack and any(x[0] == _CLOSES[ch] for x in stack):
                    while stack[-1][0] != _CLOSES[ch]:
                        stack.pop()
                    pairs.append((stack.pop()[1], s))
            continue
        if kind == "r" and js:
            before = src[max(0, s - 40) : s]
            if _BEFORE_REGEX.search(before) and (x := _JS_REGEX.match(src, s)):
                if want_code:
                    parts += [src[last:s], '"', " " * (x.end() - s - 1)]
                pos = last = x.end()
            else:
                pos = e
            continue
        if m["c"] is not None:
            comments.append((s, e))
            if kind == "badc" or "badc" in rx.groupindex and m["badc"] is not None:
                errors.append(("comment", s))
            if want_code:
                parts += [src[last:s], _blank(src[s:e])]
            pos = last = e
            continue
        if js and m["t"] is not None:
            pos = template(s, e)
            last = pos
            continue
        if "l" in rx.groupindex and m["l"] is not None:
            pos = e
            continue
        bad = line_bound and any(g in rx.groupindex and m[g] is not None for g in ("bad", "bad2", "badt", "badt2"))
        if bad:
            errors.append(("unterminated", s))
            if src[e - 1 : e] == "\n":
                e -= 1
        strings.append((s, e))
        if want_code:
            parts += [src[last:s], '"', _blank(src[s + 1 : e])]
        pos = last = max(e, s + 1)
    for b, at in stack:
        errors.append(("open", at))
    if want_code:
        parts.append(src[last:])
        out.code = "".join(parts)
    return out


# ---------------------------------------------------------------- functions and their extents

_HEAD = {
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<n>\w+)[ \t]*(?=\()", re.M),
    "javascript": re.compile(r"(?:^|(?<=[;}{\s]))(?:(?:export|default|async|static|get|set)\s+)*(?:function\s*\*?\s*(?P<n>[\w$]+)\s*(?=\()|(?:const|let|var)\s+(?P<v>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b\s*\*?\s*[\w$]*\s*)?(?=\([^\n]*(?:=>|\{))|(?<=[\s;}{])(?P<m>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|with\b|new\b|await\b|else\b)[\w$]+)\s*(?=\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)\s*(?::[^;{}\n]+)?\{))", re.M),
    "java": re.compile(r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|internal|virtual|override|sealed|async|unsafe|extern|partial|new)\s+)*(?:<[^>\n]+>\s*)?(?!return\b|new\b|else\b|throw\b|case\b|package\b|import\b)[\w.]+(?:<[^;{}()\n]*>)?(?:\[\s*\])*\??\s+(?P<n>[\w]+)\s*(?=\([^;]*?\)\s*(?:throws\s+[\w., ]+)?(?:where[^{;]+)?\s*(?:\{|=>))", re.M),
    "c": re.compile(r"^(?![ \t]*(?:return|else|if|for|while|switch|case|typedef|throw|delete|new|using|namespace)\b)[ \t]*[\w][\w\s*&:<>,~]*?[\s*&:](?P<n>~?\w+)\s*(?=\([^;{}]*\)\s*(?:const|noexcept|override|final|\s)*(?:->\s*[\w:<>&* ]+)?\s*(?::[^;{]*)?\{)", re.M),
    "go": re.compile(r"^func\s+(?:\([^)]*\)\s*)?(?P<n>\w+)(?:\[[^\]]*\])?\s*(?=\()", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<n>\w+)(?:<[^{;]*?>)?\s*(?=\()", re.M),
}
_HEAD |= {
    "php": re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?\s*(?P<n>\w+)\s*(?=\()", re.M),
    "swift": re.compile(r"^[ \t]*(?:@\w+\s+)*(?:(?:public|private|internal|fileprivate|open|static|class|final|override|mutating|convenience|required)\s+)*(?:func\s+(?P<n>\w+)(?:<[^(]*>)?|(?P<v>init)\??)\s*(?=\()", re.M),
    "zig": re.compile(r"^[ \t]*(?:pub\s+)?(?:(?:export|extern|inline)\s+)*fn\s+(?P<n>\w+)\s*(?=\()", re.M),
    "ruby": re.compile(r"^[ \t]*def\s+(?:self\.)?(?P<n>\w+[?!=]?)(?=[ \t]*(?:\(|$|;|[a-z_*&]))", re.M),
}
_HEAD |= {"typescript": _HEAD["javascript"], "csharp": _HEAD["java"], "cpp": _HEAD["c"]}


_RUBY_END = re.compile(r"\s*\n[ \t]*end\b")
_INDENT = re.compile(r"[ \t]*")


def indented_end(code: str, head: int, body: int) -> int:
    """Where the indented block of the head at ``head`` ends."""
    start = code.rfind("\n", 0, head) + 1
    indent = _INDENT.match(code, start).end() - start
    at = code.find("\n", body)
    end = len(code) if at < 0 else at
    while 0 <= at < len(code):
        nxt = code.find("\n", at + 1)
        line = code[at + 1 : nxt if nxt >= 0 else len(code)]
        text = line.lstrip(" \t")
        if text.strip():
            if len(line) - len(text) <= indent:
                break
            end = nxt if nxt >= 0 else len(code)
        at = nxt
    return end


def docstring(src: str, k: Skim, head: int) -> str | None:
    """The string that opens the body of the Python function whose head begins at ``head``."""
    code = k.code
    op = code.find("(", head)
    if op < 0:
        return None
    close = k.closing.get(op)
    if close is None:
        return None
    colon = code.find(":", close)
    if colon < 0:
        return None
    at = colon + 1
    while at < len(code) and code[at].isspace():
        at += 1
    for s in (at, at + 1, at + 2):
        if s in k.string_ends and (s == at or code[at:s].lower() in ("r", "u", "b", "ru", "ur")):
            return src[s : k.string_ends[s]]
    return None


def walk_functions(src: str, lang: str) -> Iterator[tuple[str, int, int, str | None]]:
    """(symbol, begin, end, documentation) of every function of the text."""
    yield from functions_in(src, lang, skim(src, lang))


def functions_in(src: str, lang: str, k: Skim) -> Iterator[tuple[str, int, int, str | None]]:
    """The same from a walk already done."""
    code, closing, ends = k.code, k.closing, k.in_order
    for m in _HEAD[lang].finditer(code):
        name = next(x for x in m.groups() if x)
        begin = m.start() + (len(m[0]) - len(m[0].lstrip()))
        op = code.find("(", m.end())
        if lang == "ruby" and (op < 0 or "\n" in code[m.end() : op]):
            op = -1  # parameters without parentheses
        close = closing.get(op, op) if op >= 0 else m.end()
        if lang == "python":
            end = indented_end(code, begin, close)
            doc = docstring(src, k, begin)
        elif lang == "ruby":  # to the line of the end that stands as far in as the head
            end, doc = indented_end(code, begin, m.end()), None
            if last := _RUBY_END.match(code, end):
                end = last.end()
        else:
            brace = code.find("{", close)
            semi = code.find(";", close)
            if brace < 0 or 0 <= semi < brace:
                if "=>" not in code[close : semi if semi >= 0 else len(code)]:
                    continue
                end = semi + 1 if semi >= 0 else len(code)
            else:
                end = closing.get(brace, len(code) - 1) + 1
            doc = None
        if doc is None:
            # comments that end right above the head, with nothing but white space between
            low, parts = begin, []
            for at in range(bisect_left(ends, (begin, 0)) - 1, -1, -1):
                s, e = ends[at]
                between = src[e:low]
                if between.strip() or between.count("\n") > 1 or code[code.rfind("\n", 0, s) + 1 : s].strip():
                    break
                parts.append(src[s:e])
                low = s
            doc = "\n".join(reversed(parts)) or None
        yield name, begin, end, doc
