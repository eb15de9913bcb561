"""Problem 7: credentials embedded in source code.

Lexical tokens of the places that could hold a credential are labelled O, B or I by a linear-chain
conditional random field over shape and context features; Viterbi spans say which characters of a
literal are hidden, so the code around them stays as it is. The field is trained here, on labelled
lines made by ``training_lines`` from a fixed seed (``TRAINING_LINES`` of them, a documented bound) out of the
grammar of assignments, calls, settings, commands and comments, random syllables and random values; no line or
value of any table is among them. Every row of the tables is searched in full, every line as a whole.

Cases: null and empty texts give no rows and stay as they are; a value in pieces gives one row, at its
first piece; lines end at LF only; repeated rows are rows of their own; other columns are kept by
``redact`` and ignored by ``find_credentials``; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import language_of, skim
from .languages import lexer_for

TRAINING_LINES = 5000
SEED = 7
LABELS = ("O", "B", "I")

# ---------------------------------------------------------------- where to look

_SETTINGS_EXT = (".env", ".yaml", ".yml", ".json", ".properties", ".toml", ".sh", ".ini", ".cfg", ".conf")
_HEAD = re.compile(r"-----BEGIN ([A-Z0-9 ]*)-----")
_END = re.compile(r"-----END [A-Z0-9 ]*-----")
# what parts the lines of a key: line ends, also escaped, and the quotes of its pieces
_KEY_BREAK = re.compile(r"\r?\n|(?:\\+[rn])+|[\"'`]")
_KEY_EDGE = " \t,;.()&#*>|\\-"
_KEY_HEADER = re.compile(r"[A-Z][A-Za-z-]+: [^\n]*")
# where a literal or comment can begin that goes on over a line's end
_LONG = re.compile(r"/\*|\"\"\"|\'\'\'|`|R\"|@\$?\"|\$@\"|\"[^\"\n]*\n|\\\n")
# a line outside these has no literal and no comment, so tokenize gives no value there
_LITERAL = re.compile(r"[\"'`#*]|//|<!--|-- |-----BEGIN")
MEMORY = 50_000  # labelled lines remembered in a process; beyond it the memory starts anew, results stay the same

# ---------------------------------------------------------------- tokens

_URL = re.compile(r"([A-Za-z][\w+.-]*://)([^\s:/@\"'`]*):([^\s@\"'`]+)(@)([^\s\"'`]*)")
_URL_TAIL = re.compile(r"([A-Za-z][\w+.-]*://)([^\s:/@\"'`]*):([^\s@\"'`/]+)$")
_CODE_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]")
_CHUNK = re.compile(r"-----BEGIN [A-Z0-9 ]*-----|\{\{.*?\}\}|\$\{[^}]*\}|<[A-Za-z][^<>]*>|\S+")
_KEY_CHUNK = re.compile(_CHUNK.pattern[:-3] + r"(?:(?!-----BEGIN [A-Z0-9 ]*-----)\S)+")
_SPACES = re.compile(r"\s+")
_IN_PARENTHESES = re.compile(r"\(([^()]+)\)[.,;:]*")
_NAME_SEP = re.compile(r"([A-Za-z_][\w.\-]*)([ \t]*)(:=|=>|[:=])(?!/)([ \t]*)")


def _words(text: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+", text)]


def _content(text: str, base: int, out: list, state: dict) -> None:
    """Tokens of the inside of a literal, of a comment or of a bare value."""
    pos = 0
    chunks = _KEY_CHUNK if "-----BEGIN" in text else _CHUNK
    if state.get("tail") and "@" in text.split(" ")[0]:
        at = text.index("@")
        out.append((base, base + at, "v"))
        out.append((base + at, base + len(text), "w"))
        state["tail"] = False
        return
    state["tail"] = False
    while pos < len(text):
        m = chunks.search(text, pos)
        if not m:
            break
        s, e = m.span()
        chunk = m[0]
        if u := _URL.match(chunk):
            for g, kind in ((1, "u"), (2, "n"), (3, "v"), (4, "@"), (5, "w")):
                if u.end(g) > u.start(g):
                    out.append((base + s + u.start(g), base + s + u.end(g), kind))
        elif u := _URL_TAIL.match(chunk):
            for g, kind in ((1, "u"), (2, "n"), (3, "v")):
                out.append((base + s + u.start(g), base + s + u.end(g), kind))
            state["tail"] = True
        else:
            if p := _IN_PARENTHESES.fullmatch(chunk):
                s, e = s + 1, s + 1 + len(p[1])
            while e > s + 1 and text[e - 1] in ",;)":
                e -= 1
            if e > s + 2 and text[s] == text[e - 1] == "`":
                s, e = s + 1, e - 1
            out.append((base + s, base + e, "v" if e - s > 3 else "w"))
        pos = m.end()


def tokenize(line: str, setting: bool, inside: int = 0) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the tokens of one line, whose first ``inside`` characters go on a comment or literal
    of an earlier line. Kinds: n name, v value, w word, q quote, u scheme, p other."""
    out: list = []
    state: dict = {}
    pos, n = 0, len(line)
    first = n - len(line.lstrip())
    if inside:
        out = tokenize("#" + line[:inside], setting)
        out = [(max(0, s - 1), e - 1, kind) for s, e, kind in out]
        pos = inside
    while pos < n:
        ch = line[pos]
        if ch.isspace():
            pos = _SPACES.match(line, pos).end()
            continue
        if ch == "-" and (m := _HEAD.match(line, pos)):
            out.append((pos, m.end(), "v"))
            pos = m.end()
            continue
        if ch in "\"'`":
            end = pos + 1
            while end < n and line[end] != ch:
                end += 2 if line[end] == "\\" else 1
            end = min(end, n)
            inner = line[pos + 1 : end]
            out.append((pos, pos + 1, "q"))
            name = " " not in inner and re.match(r"[ \t]*:(?!:)", line[end + 1 : end + 5])
            if name:
                out.append((pos + 1, end, "n"))
            else:
                _content(inner, pos + 1, out, state)
            if end < n:
                out.append((end, end + 1, "q"))
            pos = end + 1
            continue
        comment = ch in "/#*<-" and (line.startswith(("//", "/*", "<!--"), pos) or (ch == "#" and not line.startswith(("#include", "#define", "#pragma"), pos)) or (ch == "*" and pos == first) or line.startswith("-- ", pos))
        if comment:
            body = line[pos:]
            out.append((pos, pos + 1, "#"))
            m = re.match(r"[/#*<!-]+\s*", body)
            start = pos + m.end()
            rest = line[start:]
            if (x := _NAME_SEP.match(rest)) and not _URL.match(rest) and not rest.startswith("::", x.start(3)):
                out.append((start, start + len(x[1]), "n"))
                out.append((start + x.start(3), start + x.end(3), "="))
                tail = start + x.end()
                if line[tail : tail + 1] in ("\"", "'", "`"):
                    pos = tail
                    continue
                _content(line[tail:], tail, out, state)
            else:
                cut = min([i for i in (rest.find('"'), rest.find("'")) if i >= 0 and (i == 0 or rest[i - 1] in " =:(")] or [len(rest)])
                _content(rest[:cut], start, out, state)
                if cut < len(rest):
                    pos = start + cut
                    continue
            break
        if setting and (x := _NAME_SEP.match(line, pos)):
            out.append((pos, pos + len(x[1]), "n"))
            out.append((x.start(3), x.end(3), "="))
            pos = x.end()
            if pos < n and line[pos] not in "\"'`":
                end = line.find(" #", pos)
                end = n if end < 0 else end
                _content(line[pos:end], pos, out, state)
                pos = end
            continue
        if setting:
            m = re.compile(r"[^\s\"'`=]+=?").match(line, pos) or re.compile(r"\S").match(line, pos)
            if u := _URL.match(line, pos):
                _content(u[0], pos, out, state)
                pos = u.end()
                continue
            text = m[0]
            if ":" in text[:-1] and not text.startswith("-") and out and line[out[-1][0] : out[-1][1]] in ("-u", "--user"):
                at = text.index(":")
                out += [(pos, pos + at, "n"), (pos + at, pos + at + 1, "="), (pos + at + 1, pos + len(text), "v")]
            else:
                out.append((pos, m.end(), "v" if len(text) > 3 else "w"))
            pos = m.end()
            continue
        m = _CODE_TOKEN.match(line, pos)
        if not m:
            pos += 1
            continue
        out.append((pos, m.end(), "n" if m[0][0].isalpha() or m[0][0] in "_$" else "p"))
        pos = m.end()
    return out


# ---------------------------------------------------------------- features

_PASS = {"password", "passwd", "pwd", "pass", "passphrase", "passcode", "pin", "credential", "credentials", "cred", "creds", "login", "userpass"}
_SECRET = {"secret", "secrets", "hmac", "signing", "salt", "private", "encryption", "encrypt", "cipher", "master"}
_TOKEN = {"token", "tokens", "auth", "authorization", "bearer", "jwt", "oauth", "session", "apikey", "access", "webhook", "hook"}
_KEY = {"key", "keys", "apikey", "pem"}
_CONN = {"url", "uri", "dsn", "conn", "connection", "database", "jdbc", "endpoint"}
_HARMLESS = {"digest", "sha", "sha1", "sha256", "md5", "hash", "checksum", "commit", "revision", "request", "trace", "uuid", "guid", "etag", "integrity", "fingerprint", "public", "pub", "icon", "image", "data", "thumbnail", "avatar", "blob", "version", "build", "color"}
_ABOUT = {"name", "field", "type", "label", "path", "file", "id", "param", "prefix", "length", "size", "count", "ttl", "expiry", "policy", "hint", "column", "header", "env", "var", "ref"}
_PLACEHOLDER = re.compile(r"^<.*>$|^\$\{?\(?\w|^\{\{|^%\w|^\*+$|^x{3,}|x{6,}|^\.{3}|example|your[_\W]|^your|change.?me|placeholder|redacted|not.?set|goes.?here|^(?:dummy|sample|fake|insert|replace|test|todo|fixme|empty|undefined|none|null|nil|tbd|n/a|secret|password|true|false|user.?password)(?:[_-]?(?:me|this|here|it|password|secret|key|token|value))?\W*$|^-+$", re.I)
_PREFIX = re.compile(r"^(?:(AKIA|ASIA)[A-Z0-9]{12,}|(gh[pousr]_)[A-Za-z0-9]{20,}|(github_pat_)\w{20,}|(xox[abeprs]-)[\w-]{10,}|([srp]k_(?:live|test)_)\w{8,}|(eyJ)[\w-]+\.[\w.-]+|(AIza)[\w-]{20,}|(glpat-)[\w-]{10,}|(npm_)\w{20,}|(SG\.)[\w.-]{20,}|(ya29\.)[\w-]{10,}|(hf_)\w{16,}|(dop_v1_)\w{16,})")
_SPLIT_PREFIX = re.compile(r"^(?:AKIA|ASIA|AIza|glpat-|gh[pousr]_|xox[abeprs]-|[srp]k_live_|eyJ)[\w.+/=-]*$")
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
_PHRASE = re.compile(r"^[a-z]+(?:[-_.][a-z]+){2,}\d{1,4}\W?$")
_WORDPASS = re.compile(r"^[A-Z][a-z]+\d{2,4}[^\w\s]?$")
_B64 = re.compile(r"^[A-Za-z0-9+/]+={0,2}$")
_HEX = re.compile(r"^[0-9a-fA-F]+$")
_CUES = _PASS | _SECRET | _KEY | {"token", "tokens", "auth", "apikey", "sign"}
_USER = re.compile(r"^(?:svc|app|admin|user|root|deploy|ci|bot|ops|db|sa|service|guest)(?:[_-]\w+)?$")


def _bin(n: int) -> str:
    return "0" if n < 4 else "4" if n < 6 else "6" if n < 8 else "8" if n < 12 else "12" if n < 16 else "16" if n < 24 else "24" if n < 32 else "32" if n < 48 else "48" if n < 80 else "80"


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in (text.count(x) for x in set(text)))


@lru_cache(maxsize=MEMORY)
def shape(text: str) -> str:
    """The class of a value's form."""
    if text.startswith("-----BEGIN"):
        return "pem_private" if "PRIVATE" in text else "pem_other"
    if "://" in text:
        return "address"
    if _PLACEHOLDER.search(text):
        return "placeholder"
    if _PREFIX.match(text):
        return "prefix"
    if _UUID.match(text):
        return "uuid"
    if text.startswith(("sha1-", "sha256-", "sha384-", "sha512-", "sha256:", "md5:")):
        return "digest"
    if text.startswith("data:"):
        return "data"
    if text.startswith(("ssh-", "ecdsa-", "AAAA")):
        return "public"
    if len(text) >= 40 and len(text) % 4 == 0 and _B64.match(text) and re.search(r"\d", text) and re.search(r"[a-z]", text) and re.search(r"[A-Z]", text) and not _HEX.match(text):
        return "base64"
    if "://" in text or text.startswith(("/", "./", "../", "www.")):
        return "address"
    if _SPLIT_PREFIX.match(text) and len(text) >= 8:
        return "prefix_piece"
    digits = sum(c.isdigit() for c in text)
    letters = sum(c.isalpha() for c in text)
    if not letters:
        return "number" if digits else "marks"
    if any(ord(c) > 127 for c in text) or text.count("\\u") + text.count("\\x") > 1 or re.search(r"^\\u[0-9a-fA-F]{4}|\\u(?!00[0-7])[0-9a-fA-F]{4}", text):
        return "foreign"
    if re.match(r"^[A-Za-z]{1,2}u?'[a-z]+[.,:]?$", text):
        return "plain"
    if _PHRASE.match(text):
        return "phrase"
    if _WORDPASS.match(text):
        return "wordpass"
    n = len(text)
    if _HEX.match(text) and n >= 16 and digits:
        return "hex"
    lower = any(c.islower() for c in text)
    upper = any(c.isupper() for c in text)
    if _B64.match(text) and n >= 20 and digits and lower and upper and (n % 4 == 0 or n >= 40):
        return "base64"
    special = any(not c.isalnum() and c not in "-_./,:" for c in text)
    kinds = lower + upper + bool(digits) + special
    parts = _words(text)
    wild = n >= 8 and len(parts) > 1 and (letters + digits) / len(parts) < 3.6 or any(len(w) >= 4 and w.isalpha() and not re.search(r"[aeiouy]", w) for w in parts)
    if wild and lower and upper and n >= 8 and "/" not in text:
        return "mixed"
    if re.match(r"^[A-Za-z_][\w.]*(?:\[\w*\])?(?:\([A-Za-z_.]*)?\)?$", text) and (not digits or re.match(r"^[a-z_A-Z.]+?\d{0,3}$", text)) and not (kinds >= 3 and digits >= 2):
        return "name"
    if re.match(r"^[A-Za-z_][A-Za-z_.]*(?:\[\d{1,4}\]?|\(\d{1,4})\)?$", text):
        return "name"
    if re.match(r"^[\w./-]+\.(?:csv|log|txt|json|html?|js|py|png|jpe?g|svg|md|ya?ml|xml)$", text):
        return "file"
    if re.match(r"^[a-z]+(?:[-_./][a-z]+)*(?:[-_]?\d{1,4})?$", text):
        return "plain"
    if re.match(r"^[\w.-]+(?::\d+)?(?:/[\w./-]*)?$", text) and "." in text and not upper:
        return "host"
    if n >= 8 and kinds >= 3 and _entropy(text) >= 2.6:
        return "mixed"
    if n >= 8 and kinds >= 2 and (special or digits >= 2) and _entropy(text) >= 2.6:
        return "mixed2"
    return "other"


@lru_cache(maxsize=MEMORY)
def name_class(text: str) -> str:
    """What a name says of the value it holds."""
    w = set(_words(text))
    joined = "".join(_words(text))
    about = bool(w & _ABOUT)
    if w & _HARMLESS and not w & _PASS and "secret" not in w:
        return "harmless"
    if w & {"passphrase", "mnemonic"} and not about:
        return "phrase"
    if w & _PASS:
        return "pass_about" if about and not w & {"password"} or (w & {"field", "name", "policy", "length", "hint", "label", "type", "column"}) else "pass"
    if w & _SECRET or "secret" in joined:
        return "secret_about" if w & {"name", "path", "ref", "type", "field", "label", "version"} else "secret"
    if w & _KEY or joined.endswith("key"):
        return "key"
    if w & _TOKEN:
        return "token_about" if w & {"type", "name", "field", "ttl", "count", "limit", "url"} else "token"
    if w & _CONN:
        return "conn"
    return "neutral"


@lru_cache(maxsize=MEMORY)
def _is_cue(text: str) -> bool:
    return len(text) < 16 and any(w in _CUES for w in _words(text))


@lru_cache(maxsize=MEMORY)
def _value_features(sh: str, ctx: str, size: str, setting: bool) -> tuple[str, ...]:
    return "sh:" + sh, "ctx:" + ctx, f"sh|ctx:{sh}|{ctx}", f"sh|len:{sh}|{size}", f"setting:{setting}"


_JOINTS = ("+", "..", ".", "\\", "&", ",")
# what tokens other than values have; of these there are few
_PLAIN = {kind: ("kind:" + kind, "bias", *(["w"] if kind == "w" else [])) for kind in "nwq#=u@p"}
_PUNCT = {(kind, text): (*row, "punct:" + text) for kind, row in _PLAIN.items() for text in _JOINTS}
_CALL_PAIR = re.compile(r"\([\"']x[\"'],[\"']x?$")


def features(line: str, toks: list[tuple[int, int, str]], setting: bool) -> list[tuple[str, ...]]:
    """Shape and context features of every token."""
    rows: list[tuple[str, ...]] = []
    name, comment, cue, user, scheme = "none", False, 0, False, False
    literal, since = False, 9  # a literal ended so many tokens ago, with nothing but joints since
    held = "none"  # the name class of the value that the last literal belongs to
    last_value = "none"
    prev_text = ""
    concat = "concat" in line
    for at, (s, e, kind) in enumerate(toks):
        text = line[s:e]
        if kind == "v":
            if _is_cue(text):
                cue = 5
            sh = shape(text)
            ctx = name if not comment or name not in ("none", "neutral") else ("cue" if cue else "comment")
            f = ["kind:v", "bias", *_value_features(sh, ctx, _bin(e - s), setting)]
            if scheme and rows and rows[-1][0] in ("kind:n", "kind:u") and not prev_text.endswith(":"):
                f += ["url", "url|" + ("ph" if sh == "placeholder" else "val")]
            if at + 1 < len(toks) and toks[at + 1][2] == "q":
                after = [line[a:b] for a, b, _ in toks[at + 1 : at + 4]]
                if "".join(after) in ('"+"', "'+'", '","' if concat else '"+"') or "".join(after[:2]) in ('""', "''"):
                    f += ["split", f"split|{ctx}"]
            if literal and since <= 3:
                f += ["joint", f"joint|{last_value}", f"joint|{held}"]
            if at and (toks[at - 1][2] == "q" or at > 1 and toks[at - 2][2] == "q"):
                before = "".join(["x" if k == "w" or k == "v" else line[a:b] for a, b, k in toks[max(0, at - 6) : at]])
                if _CALL_PAIR.search(before):
                    f += ["pair", f"pair|{sh}"]
            if user:
                f += ["user", f"user|{sh}"]
            if prev_text in ("Basic", "Bearer", "Token"):
                f += ["scheme_word", f"scheme_word|{sh}"]
            if comment and cue:
                f.append(f"cue|{sh}")
            if text in _JOINTS:
                f.append("punct:" + text)
            last_value, held = sh, name
            if sh in ("name", "plain", "other") and _USER.match(text):
                user = True
            if cue:
                cue -= 1
            rows.append(tuple(f))
        else:
            if kind == "#":
                comment, name = True, "none"
            elif kind == "n" and (not comment or len(text) < 30):
                c = name_class(text)
                if c != "neutral" or name == "none" or not literal:
                    name = c if c != "neutral" or name in ("none", "neutral") else name
                if _USER.match(text):
                    user = True
            elif kind == "u":
                scheme = True
            elif kind == "w" and _is_cue(text):
                cue = 5
            if kind == "q":
                if rows and rows[-1][0] in ("kind:v", "kind:w"):
                    literal, since = True, 0
            elif text in ("+", "\\", "..") or (kind == "p" and text == "," and concat):
                since += 1 if since < 9 else 0
            elif kind not in ("w", "u", "@"):
                literal, since = False, 9
                if text in (";", "{", "}") or text == ",":
                    scheme = False
                    if text != ",":
                        name = "none"
            rows.append(_PUNCT[kind, text] if text in _JOINTS else _PLAIN[kind])
        prev_text = text
    return rows


# ---------------------------------------------------------------- the conditional random field


class Crf:
    """Linear-chain conditional random field with three labels, trained by full-batch gradients."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.index, self.weights, self.steps = index, weights, steps
        self.scores: dict[tuple[str, ...], list[float]] = {}

    @classmethod
    def train(cls, data: list[tuple[list[tuple[str, ...]], list[int]]], rounds: int = 60, l2: float = 0.02) -> Crf:
        index: dict[str, int] = {}
        for rows, _ in data:
            for f in rows:
                for x in f:
                    index.setdefault(x, len(index))
        nf, n, t = len(index), len(data), max(len(r) for r, _ in data)
        width = max(len(f) for r, _ in data for f in r)
        idx = np.full((n, t, width), nf)
        y = np.zeros((n, t), int)
        mask = np.zeros((n, t), bool)
        for i, (rows, labels) in enumerate(data):
            for j, f in enumerate(rows):
                idx[i, j, : len(f)] = [index[x] for x in f]
            y[i, : len(labels)] = labels
            mask[i, : len(labels)] = True
        w, a = np.zeros((nf + 1, 3)), np.zeros((3, 3))
        gw2, ga2 = np.full_like(w, 1e-8), np.full_like(a, 1e-8)
        rows_i = np.arange(n)
        gold = np.zeros_like(w)
        flat = idx[mask]
        for k in range(3):
            gold[:, k] = np.bincount(flat[y[mask] == k].ravel(), minlength=nf + 1)
        gold_a = np.zeros((3, 3))
        np.add.at(gold_a, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
        for _ in range(rounds):
            w[nf] = 0
            s = w[idx].sum(2)
            alpha = np.zeros((n, t, 3))
            alpha[:, 0] = s[:, 0]
            for j in range(1, t):
                x = alpha[:, j - 1, :, None] + a
                m = x.max(1)
                nxt = m + np.log(np.exp(x - m[:, None]).sum(1)) + s[:, j]
                alpha[:, j] = np.where(mask[:, j, None], nxt, alpha[:, j - 1])
            beta = np.zeros((n, t, 3))
            for j in range(t - 2, -1, -1):
                x = a + (s[:, j + 1] + beta[:, j + 1])[:, None, :]
                m = x.max(2)
                nxt = m + np.log(np.exp(x - m[..., None]).sum(2))
                beta[:, j] = np.where(mask[:, j + 1, None], nxt, 0)
            m = alpha[:, -1].max(1, keepdims=True)
            z = (m + np.log(np.exp(alpha[:, -1] - m).sum(1, keepdims=True)))[:, 0]
            p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
            grad = gold - l2 * w
            pm = p[mask]
            for k in range(3):
                grad[:, k] -= np.bincount(flat.ravel(), weights=np.repeat(pm[:, k], width), minlength=nf + 1)
            pair = np.exp(alpha[:, :-1, :, None] + a + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
            grad_a = gold_a - (pair * mask[:, 1:, None, None]).sum((0, 1)) - l2 * a
            gw2 += grad**2
            ga2 += grad_a**2
            w += 0.9 * grad / np.sqrt(gw2)
            a += 0.5 * grad_a / np.sqrt(ga2)
        del rows_i
        w[nf] = 0
        return cls(index, w[:nf], a)

    def viterbi(self, rows: list[tuple[str, ...]]) -> list[int]:
        get, w, a, scores = self.index.get, self.weights, self.steps.tolist(), self.scores
        if len(scores) > MEMORY:
            scores.clear()
        emitted, quiet = [], True
        for f in rows:
            s = scores.get(f)
            if s is None:
                ids = [i for i in map(get, f) if i is not None]
                e = w[ids].sum(0).tolist() if ids else [0.0, 0.0, 0.0]
                # no path gains by leaving O here, whatever steps lead in and out
                s = scores[f] = (*e, all(e[k] - e[0] + max(0.0, *(a[j][k] - a[0][0] for j in range(3))) + max(0.0, a[k][0] - a[0][0]) < 0 for k in (1, 2)))
            emitted.append(s)
            quiet = quiet and s[3]
        if quiet:
            return [0] * len(rows)
        best, back = None, []
        for s in emitted:
            if best is None:
                best = s
                continue
            nxt, ptr = [], []
            for k in range(3):
                c = [best[0] + a[0][k], best[1] + a[1][k], best[2] + a[2][k]]
                b = 0 if c[0] >= c[1] and c[0] >= c[2] else 1 if c[1] >= c[2] else 2
                nxt.append(c[b] + s[k])
                ptr.append(b)
            best = nxt
            back.append(ptr)
        if best is None:
            return []
        k = max(range(3), key=lambda i: best[i])
        path = [k]
        for ptr in reversed(back):
            k = ptr[k]
            path.append(k)
        return path[::-1]


# ---------------------------------------------------------------- labelled lines to train on


_SYLLABLES = [o + v + c for o in "b c d f g h k l m n p r s t v br cl dr gr pl st tr".split() for v in "aeiou" for c in ("", "n", "r", "l", "s")]
_B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


class _Maker:
    """Random lines of code, settings and comments with and without credentials, from the grammar of each form. Nouns are
    random syllables, names are put together from the words that ``name_class`` knows, values from random characters
    in the published formats of keys, so no line stands here as a text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, chars: str, low: int, high: int | None = None) -> str:
        return "".join(self.r.choice(chars) for _ in range(self.r.randint(low, high or low)))

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(2, 3)))

    def words(self, low: int, high: int) -> list[str]:
        return [self.word() for _ in range(self.r.randint(low, high))]

    def b64(self, low: int, high: int | None = None) -> str:
        return base64.b64encode(self.r.randbytes(self.r.randint(low, high or low))).decode()

    def hexa(self, *sizes: int) -> str:
        return self.pick("0123456789abcdef", self.r.choice(sizes))

    # ---- values

    def strong(self) -> str:
        """A key in a published format."""
        jwt = lambda: "eyJ" + self.pick(_B62, 20, 40) + ".eyJ" + self.pick(_B62, 20, 60) + "." + self.pick(_B62 + "-_", 43)
        formats = (
            lambda: self.r.choice(("AKIA", "ASIA")) + self.pick(_B62[:26] + "234567", 16), lambda: self.r.choice(("ghp_", "gho_", "ghs_", "ghu_")) + self.pick(_B62, 36),
            lambda: "xox" + self.r.choice("bpa") + "-" + self.pick("0123456789", 10, 13) + "-" + self.pick(_B62, 24), lambda: self.r.choice("sr") + "k_live_" + self.pick(_B62, 24, 32),
            jwt, lambda: "AIza" + self.pick(_B62, 35), lambda: "glpat-" + self.pick(_B62, 20), lambda: "npm_" + self.pick(_B62, 36), lambda: "SG." + self.pick(_B62, 22) + "." + self.pick(_B62, 43), lambda: "hf_" + self.pick(_B62, 34),
        )
        return self.r.choice(formats)()

    def pem(self, private: bool = True) -> str:
        kind = self.r.choice(("RSA ", "EC ", "OPENSSH ", "DSA ", "")) + "PRIVATE KEY" if private else self.r.choice(("CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY"))
        return f"-----BEGIN {kind}-----"

    def weak(self) -> str:
        """A value that only its place tells from other texts."""
        forms = (
            lambda: self.r.choice("-_.").join(self.words(3, 5)) + self.pick("0123456789", 1, 3), lambda: self.pick(_B62 + "!@#$%_-+&*?", 10, 22) + self.r.choice("0123456789"),
            lambda: self.word().title() + self.pick("0123456789", 2, 4) + self.pick("!@#$+", 0, 1), lambda: self.pick(_B62, 11, 24) + self.r.choice("0123456789"),
            lambda: self.hexa(24, 32, 40, 48, 64), lambda: self.b64(24, 64),
        )
        return self.r.choice(forms)()

    def secret(self) -> str:
        return self.weak() if self.r.random() < 0.6 else self.strong()

    def placeholder(self) -> str:
        w, k = self.word(), self.r.choice(("password", "token", "key", "secret"))
        forms = (
            lambda: f"<{w}>", lambda: f"<{w}-{k}>", lambda: f"${{{w.upper()}_{k.upper()}}}", lambda: f"${w.upper()}", lambda: f"{{{{ {w}_{k} }}}}", lambda: f"{{{{ {w}.{k} }}}}", lambda: "*" * self.r.randint(4, 12), lambda: "x" * self.r.randint(4, 12),
            lambda: f"your_{w}_{k}", lambda: f"YOUR_{k.upper()}", lambda: f"insert-{k}-here", lambda: "changeme", lambda: "TODO", lambda: self.r.choice(("none", "null", "true", "false")), lambda: k, lambda: "AKIA" + self.pick(_B62[:26], 5) + "EXAMPLE" + self.pick(_B62[:26], 4), lambda: f"example-{w}",
        )
        return self.r.choice(forms)()

    def plain(self) -> str:
        w = self.word
        forms = (
            w, lambda: "-".join(self.words(2, 2)), lambda: f"{w()}/{w()}.{self.r.choice(('csv', 'json', 'txt', 'py'))}", lambda: f"https://{w()}.test:{self.r.randint(1000, 9999)}/{w()}", lambda: str(self.r.randint(1, 9999)), lambda: f"{w()}-{self.r.randint(1, 999)}", lambda: " ".join(self.words(3, 7)),
            self.uuid, lambda: f"{w()}.{w()}.test:{self.r.randint(80, 9999)}", lambda: f"v{self.r.randint(1, 9)}.{self.r.randint(0, 20)}.{self.r.randint(0, 9)}", lambda: "#" + self.hexa(6), lambda: f"{w().title()} {w()} {self.r.randint(3, 99)} {w()}", lambda: self.r.choice(("utf-8", "iso-8859-1")), lambda: f"application/{w()}; charset=utf-8",
            lambda: f"{w()}_{w()}", lambda: w() + w().title(), lambda: f"%s {w()} %d", lambda: f"2024-0{self.r.randint(1, 9)}-1{self.r.randint(0, 9)}", lambda: f"{w()}{self.r.randint(1, 9)}-{w()}",
        )
        return self.r.choice(forms)()

    def uuid(self) -> str:
        return "-".join(self.hexa(k) for k in (8, 4, 4, 4, 12))

    # ---- names

    def styled(self, parts: list[str]) -> str:
        k = self.r.randint(0, 3)
        return "_".join(parts).upper() if k == 0 else parts[0] + "".join(x.title() for x in parts[1:]) if k == 1 else "_".join(parts)

    def secret_name(self) -> str:
        r = self.r
        core = r.choice((["password"], ["passwd"], ["pwd"], ["pass"], ["passphrase"], ["credential"], ["secret"], ["client", "secret"], ["signing", "key"], ["hmac", "key"], ["encryption", "key"], ["private", "key"], ["master", "key"], ["token"], ["auth", "token"], ["access", "token"], ["session", "token"], ["bearer"], ["jwt"], ["api", "key"], ["access", "key"], ["account", "key"], ["auth"], ["webhook", "secret"]))
        before = r.choice(([], [self.word()], [r.choice(("db", "app", "user", "admin", "root", "smtp", "api", "service"))]))
        return self.styled([*before, *core])

    def neutral_name(self) -> str:
        return self.styled(self.words(1, 2) + self.r.choice(([], [self.r.choice(("value", "entry", "option", "item", "config", "header", "host", "mode"))])))

    def about_name(self) -> str:
        r = self.r
        return self.styled([r.choice(("password", "secret", "token", "key", "passwd")), r.choice(("name", "field", "type", "label", "path", "length", "hint", "column", "policy", "ttl"))])

    def address_name(self) -> str:
        return self.styled([self.word(), self.r.choice(("url", "uri", "dsn", "endpoint", "connection"))])

    def harmless(self) -> tuple[str, str]:
        r = self.r
        name, value = r.choice((("digest", lambda: "sha256-" + self.b64(32)), ("checksum", lambda: self.hexa(64)), ("sha1", lambda: self.hexa(40)), ("md5", lambda: self.hexa(32)), ("commit", lambda: self.hexa(40)), ("revision", lambda: self.hexa(12, 40)), ("etag", lambda: self.hexa(32)), ("trace_id", lambda: self.hexa(32)), ("request_id", self.uuid), ("uuid", self.uuid), ("image_data", lambda: "data:image/png;base64," + self.b64(40, 80)), ("icon", lambda: self.b64(40, 90)), ("public_key", lambda: r.choice(("ssh-ed25519 ", "ssh-rsa ")) + "AAAA" + self.pick(_B62, 60) + f" {self.word()}@host.test"), ("image_hash", lambda: self.b64(32)), ("fingerprint", lambda: "sha256:" + self.b64(32)), ("public_key", lambda: self.pem(False))))
        return self.styled([*self.words(0, 1), *name.split("_")]), value()

    # ---- lines; "N" stands for the name, "V" for the value

    CODE = ('N = "V"', "N = 'V'", 'N: str = "V"', 'const N = "V";', "let N = 'V';", "var N = 'V'", 'const N: string = "V";', 'String N = "V";', 'private static final String N = "V";', 'std::string N = "V";', 'const char *N = "V";', '#define N "V"', 'string N = "V";', 'N := "V"', 'const N = "V"', 'let N = "V";', 'const N: &str = "V";', '{"W": "w", "N": "V"}', '{"N": "V"}', "N: 'V',", 'self.N = "V"', 'config["N"] = "V"', 'setW("N", "V");', '    N: "V",', 'f(N="V")', 'if (N == "V") {', 'var N = "V"; // w w', '[Attr("N", "V")]')
    SETTING = ("N=V", "N='V'", 'N="V"', "N = V", "N: V", '  N: "V"', "N: 'V'", "export N=V", 'export N="V"', '  "N": "V",', '{"N": "V"}', "W.N=V", 'N = "V"', "- N: V", "set N V")

    def fill(self, form: str, name: str, value: str) -> str:
        out = re.sub(r"\bw\b", lambda _: self.word(), re.sub(r"W", lambda _: self.word().title(), form.replace("N", "\0").replace("V", "\1")))
        return out.replace("\0", name).replace("\1", value)

    def line(self, name: str, value: str, forms: frozenset | None = None) -> tuple[str, bool, str]:
        setting = self.r.random() < 0.4
        which = self.SETTING if setting else self.CODE
        k = self.r.randrange(len(which))
        return self.fill(which[k], name, value), setting, f"{'setting' if setting else 'code'} {k}"

    def comment(self, value: str | None, cue: bool) -> tuple[str, int]:
        r = self.r
        filler = "the a for of to in on this old new our see use with until after only".split()
        some = lambda low, high: [r.choice(filler) if r.random() < 0.6 else self.word() for _ in range(r.randint(low, high))]
        said = some(0, 3) + ([r.choice(("password", "token", "key", "secret", "login", "credential", "credentials", "passphrase", "sign in", "api key"))] if cue else []) + some(0, 3)
        joint = r.choice((": ", " = ", " is ", " ", " / ", " -> ", " (", " '", ': "'))
        close = {" (": ")", " '": "'", ': "': '"'}.get(joint, "")
        k = r.randrange(5)
        mark = ("// ", "# ", " * ", "/* ", "-- ")[k]
        tail = "" if r.random() < 0.6 else " " + " ".join(some(1, 4))
        return f"{' ' * r.choice((0, 4))}{mark}{' '.join(said)}{joint + value + close if value else ''}{tail}{' */' if k == 3 else ''}", k

    def statement(self) -> tuple[str, bool, str]:
        """A line of code without a literal, also as it stands in a comment, or a documentation tag."""
        r = self.r
        name = lambda: self.styled(self.words(1, 2)) if r.random() < 0.8 else self.secret_name()
        call = lambda: f"{name()}({', '.join(name() for _ in range(r.randint(0, 3)))})"
        term = lambda: r.choice((name, name, call, lambda: str(r.randint(0, 4096)), lambda: f"{name()}.{name()}", lambda: f"{name()}[{r.randint(0, 9)}]"))()
        some = lambda: f"{term()} {r.choice('+ - * / % < > <= >= == != && ||'.split())} {term()}"
        tag, said = r.choice(("@param", ":param", "@return", ":return", "@throws", "@see", "\\\\param")), " ".join(self.words(2, 6))
        j = r.randrange(16)
        line = (
            f"if ({some()}) {{", f"while ({some()} || {some()}) {{", f"for (int i = 0; i < {term()}; i++) {{", f"{name()} = {some()};", f"let {name()}: number = ({some()}) * {r.randint(1, 64)};", f"return {some()};", f"{call()};", f"def {name()}({name()}, {name()}=None):",
            f"{tag} {name()} {said}", f":param {name()}: {said}", f"@param {name()} {said}", f"{said}: {said}.", f"{name()} - {said}", f"if {some()}:", f"{name()} += {term()}", f"// {name()}: {said}",
        )[j]
        lead = r.choice((" * ", "# ", "// ")) if 8 <= j <= 12 or r.random() < 0.25 else " " * r.choice((0, 4, 8))
        return lead + line, r.random() < 0.1, f"statement {j}"

    def made(self) -> tuple[str, list[str], bool, str]:
        """(line, hidden values in order, whether of a settings file, the form)."""
        r, k = self.r, self.r.random()
        if r.random() < 0.16:
            line, setting, form = self.statement()
            return line, [], setting, form
        if k < 0.20:
            v = r.choice((self.weak, self.weak, self.secret, self.pem))()
            line, setting, form = self.line(self.secret_name(), v)
            return line, [v], setting, form
        if k < 0.27:
            v = r.choice((self.strong, self.strong, self.strong, self.pem))()
            line, setting, form = self.line(self.neutral_name(), v)
            return line, [v], setting, form
        if k < 0.30:  # words alone, long enough or with a name that asks for words
            name = self.styled(r.choice((["passphrase"], ["passphrase"], [self.word(), "passphrase"], ["password"], [self.word(), "password"])))
            blanks = "passphrase" in name.lower()
            parts = self.words(4, 6) if blanks and r.random() < 0.6 else ["".join(self.words(4, 6))]
            line, setting, form = self.line(name, " ".join(parts))
            return line, parts, setting, form
        if k < 0.32:  # a password with blanks and marks in it
            parts = [x for p in range(r.randint(2, 4)) for x in [self.pick(_B62 + "!%&+", 4, 9) + r.choice("0123456789") + r.choice("!%+")]]
            name = self.styled([*self.words(0, 1), r.choice(("password", "passwd", "passphrase"))])
            which = r.choice([f for f in (*self.CODE, *self.SETTING) if '"V"' in f])
            return self.fill(which, name, " ".join(parts)), parts, which in self.SETTING, "blanks"
        if k < 0.39:
            v = r.choice((lambda: self.pick(_B62 + "!$%_-+*", 8, 18) + "4", lambda: self.pick(_B62, 9, 20), lambda: "-".join(self.words(2, 4)) + "7"))()
            user, host, scheme = r.choice((self.word(), r.choice(("svc_", "app_")) + self.word(), r.choice(("admin", "root", "user")), "")), f"{self.word()}.test", r.choice(("postgres", "postgresql", "mysql", "redis", "amqp", "mongodb", "mongodb+srv", "https", "ftp", "smtp"))
            url = f"{scheme}://{user}:{v}@{host}{r.choice(('', ':' + str(r.randint(1000, 9999))))}/{self.word()}"
            line, setting, form = self.line(r.choice((self.address_name, self.neutral_name))(), url)
            if r.random() < 0.3 and not setting and f'"{url}"' in line:
                at, joint = line.index(v + "@") + r.randint(2, len(v) - 1), r.choice(('" + "', '" "', '", "'))
                first = at - line.index(v + "@")
                line = line[:at] + joint + line[at:]
                if joint == '", "':
                    line = line.replace('"' + url[:3], 'concat!("' + url[:3], 1)
                return line, [v[:first], v[first:]], False, "split address"
            return line, [v], setting, "address " + form
        if k < 0.43:
            v = r.choice((lambda: self.b64(14, 36), self.strong, self.weak))()
            kind = r.choice(("Basic ", "Bearer ", "Token "))
            name = r.choice((self.styled([*self.words(0, 1), r.choice(("authorization", "auth", "header"))]), self.neutral_name()))
            if r.random() < 0.25:
                return f'"Authorization: {kind}{v}"', [v], r.random() < 0.3, "header"
            line, setting, form = self.line(name, kind + v)
            return line, [v], setting, "header " + form
        if k < 0.50:
            v = self.secret()
            at = r.randint(4, max(4, len(v) - 3))
            j = r.randrange(6)
            form = ('N = "V" + "Z";', 'const N = "V" + "Z";', 'let N = concat!("V", "Z");', 'const char *N = "V" "Z";', 'N := "V" + "Z"', 'N = "V" "Z"')[j]
            return form.replace("N", "\0").replace("V", v[:at]).replace("Z", v[at:]).replace("\0", self.secret_name()) if "V" not in v[at:] else f'x = "{v[:at]}" + "{v[at:]}"', [v[:at], v[at:]], False, f"split {j}"
        if k < 0.59:
            v = self.secret()
            line, j = self.comment(v, cue=r.random() < 0.9)
            return line, [v], r.random() < 0.2, f"comment {j}"
        if k < 0.63:
            v = self.secret()
            j = r.randrange(5)
            f = r.choice((r.choice(("connect", "login", "authenticate", "open", "auth")), self.word() + self.word().title()))
            user = r.choice((self.word(), r.choice(("svc_", "app_")) + self.word(), r.choice(("admin", "root"))))
            return (f'{f}("{user}", "{v}");', f"{f}('{user}', '{v}')", f'{self.word()}.{f}("{user}", "{v}")', f'{f}("{user}", "{v}", {r.randint(1, 99)})', f'{self.word()} = {f}("{user}", "{v}");')[j], [v], False, f"call {j}"
        if k < 0.66:
            v, user = r.choice((self.weak, self.strong))().replace("'", "x"), r.choice((self.word(), "admin", "deploy"))
            j = r.randrange(6)
            return (f"{self.word()} -u {user}:'{v}' https://{self.word()}.test/x", f"{self.word()} -u {user}:{v} https://{self.word()}.test/x", f"{self.word()} --password={v} -h {self.word()}", f"{self.word()} --token {v} --{self.word()} 4", f"{self.word()} --api-key '{v}' run", f"{self.word()} --password \"{v}\"")[j], [v], True, f"command {j}"
        if k < 0.73:
            line, setting, form = self.line(self.secret_name(), self.placeholder())
            return line, [], setting, form
        if k < 0.76:
            url = f"{r.choice(('postgres', 'mysql', 'redis', 'https'))}://{r.choice((self.word() + '@', '', self.word() + ':' + r.choice(('${PW}', '<' + self.word() + '>', '****', '{{ ' + self.word() + ' }}')) + '@'))}{self.word()}.test:{r.randint(1000, 9999)}/{self.word()}"
            line, setting, form = self.line(r.choice((self.address_name, self.secret_name, self.neutral_name))(), url)
            return line, [], setting, "address " + form
        if k < 0.80:
            up, name, j = self.styled([self.word(), r.choice(("password", "token", "key"))]).upper(), self.secret_name(), r.randrange(9)
            return (f'{name} = os.environ["{up}"]', f'{name} = os.getenv("{up}", "")', f"const {name} = process.env.{up};", f'{name} := os.Getenv("{up}")', f'let {name} = std::env::var("{up}").unwrap();', f'String {name} = System.getenv("{up}");', f'string {name} = Environment.GetEnvironmentVariable("{up}");', f'{name} = {self.word()}.read("{self.word()}/data/{self.word()}")', f'std::string {name} = std::getenv("{up}");')[j], [], False, f"environment {j}"
        if k < 0.87:
            line, setting, form = self.line(*self.harmless())
            return line, [], setting, form
        if k < 0.91:
            name = r.choice((self.about_name, self.about_name, lambda: self.styled([*self.words(0, 1), r.choice(("key", "token", "access", "session", "hook", "auth"))])))()
            line, setting, form = self.line(name, r.choice((self.word, self.word, self.plain, lambda: self.r.choice(("password", "bearer", "refresh")), lambda: f"{self.word()}_{self.word()}"))())
            return line, [], setting, form
        if k < 0.96:
            line, setting, form = self.line(self.neutral_name(), r.choice((self.plain, self.plain, self.placeholder))())
            return line, [], setting, form
        if k < 0.965:
            line, j = self.comment(None, cue=True)
            return line, [], False, f"comment {j}"
        if k < 0.975:
            line, j = self.comment(r.choice((self.plain(), self.plain(), self.hexa(40), "rev-" + self.hexa(8), self.uuid())), cue=False)
            return line, [], False, f"comment {j}"
        v = r.choice((self.b64(57), self.b64(40, 60), self.hexa(40, 64), self.plain(), self.uuid(), self.harmless()[1]))
        j = r.choice((0, 0, 0, 1, 2, 3, 4))
        return (f'    "{v}",', f'{self.word()}("{v}", {r.randint(1, 9)})', f'{self.word()}("{self.word()}", "{v}")', f'"""{v}"""', f'return "{v}";')[j], [], False, f"bare {j}"


def training_lines(n: int = TRAINING_LINES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int]], bool, str]]:
    """(line, spans of hidden characters, whether of a settings file, the form it has)."""
    make, out = _Maker(seed), []
    while len(out) < n:
        line, values, setting, form = make.made()
        spans, at = [], 0
        for v in values:
            i = line.find(v, at)
            if i < 0:
                break
            spans.append((i, i + len(v)))
            at = i + len(v)
        else:
            out.append((line, spans, setting, form))
    return out


def labelled(line: str, spans: list[tuple[int, int]], setting: bool) -> tuple[list[tuple[str, ...]], list[int]]:
    """The features and labels of one line's tokens."""
    toks = tokenize(line, setting)
    labels, begun = [], False
    for s, e, kind in toks:
        hit = kind in ("v", "w") and any(a < e and s < b for a, b in spans)
        labels.append((2 if begun else 1) if hit else 0)
        begun = begun or hit
    return features(line, toks, setting), labels


def fit(lines: list) -> Crf:
    data = [labelled(*x[:3]) for x in lines]
    return Crf.train([x for x in data if 0 < len(x[1]) <= 60])


@lru_cache(maxsize=2)
def model(n: int = TRAINING_LINES, seed: int = SEED) -> Crf:
    """The field trained on ``training_lines``; kept in the process."""
    return fit(training_lines(n, seed))


# ---------------------------------------------------------------- search of whole texts


def key_end(text: str, head: re.Match) -> int:
    """Where the key behind a header ends: at its END line, or without one behind the last line that looks like base64."""
    begin = head.end()
    nxt = _HEAD.search(text, begin)
    end = _END.search(text, begin, nxt.start() if nxt else len(text))
    if end and "PRIVATE" in head[1] and all(re.fullmatch(r"[\w+/=.]*", x) or _KEY_HEADER.fullmatch(x) for x in (y.strip(_KEY_EDGE) for y in _KEY_BREAK.split(text[begin : end.start()]))):
        return end.end()
    last = at = begin
    for m in _KEY_BREAK.finditer(text, begin):
        if not (stop := _key_line(text, at, m.start(), end)):
            break
        last, at = stop if stop > at else last, m.end()
    else:
        stop = _key_line(text, at, len(text), end) or 0
        last = stop if stop > at else last
    return end.end() if end and not text[last : end.start()].strip(_KEY_EDGE + "\r\n\"'`+nr") else last


def _key_line(text: str, a: int, b: int, end: re.Match | None) -> int | None:
    """Where the part of a key on text[a:b] ends: a itself where the line has joints only, None where it is no key's."""
    if end and a <= end.start() < b:
        b = end.start()
    line = text[a:b]
    core = line.strip(_KEY_EDGE)
    if core in ("", "+") or _KEY_HEADER.fullmatch(core) and core.startswith(("Proc-Type", "DEK-Info", "Comment", "Version")):
        return a or None
    core = core.removeprefix("+ ").removesuffix(" +").strip(_KEY_EDGE)
    if not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", core):
        return None
    whole = len(core) >= 16 and re.search(r"[0-9+/]", core) and re.search(r"[A-Z]", core)
    if whole or core.endswith("=") or end and b == end.start() or not text[b:].strip() or end and not text[b : end.start()].strip(_KEY_EDGE + "\r\n\"'`+nr"):
        return a + line.rindex(core) + len(core)
    return None


def _continued(text: str, filename: str | None) -> list[tuple[int, int]]:
    """(begin, end) of the comments and literals that go on over a line's end, in order."""
    if not _LONG.search(text):
        return []
    k = skim(text, lexer_for(text, language_of(filename)), False)
    return sorted((s, e) for s, e in (*k.comments, *k.strings) if "\n" in text[s:e])


def labelled_line(line: str, setting: bool, inside: int, crf: Crf) -> list[tuple[int, int, bool]]:
    """(begin, end, whether a value begins) of the characters of one line to hide."""
    toks = tokenize(line, setting, inside)
    if not any(k == "v" for _, _, k in toks):
        return []
    labels = crf.viterbi(features(line, toks, setting))
    out: list[tuple[int, int, bool]] = []
    for (s, e, kind), y in zip(toks, labels):
        if y and kind in ("v", "w"):  # words of one literal, with blanks only between them, are one value
            out.append((s, e, not out or y == 1 and not line[out[-1][1] : s].isspace()))
    return out


def spans_of(text: str | None, setting: bool, crf: Crf, filename: str | None = None, memory: dict | None = None) -> list[tuple[int, int, bool]]:
    """(begin, end, whether a value begins) of the characters to hide. Every line is labelled as a whole; only lines
    that give no value are left out. A key is labelled by its header, its text is left out of the line."""
    if not text:
        return []
    memory = {} if memory is None else memory
    keys, cuts, parts, low = {}, [], [], 0
    if "-----BEGIN" in text:
        whole, text = text, ""
        for m in _HEAD.finditer(whole):
            if m.start() < low:
                continue
            end = key_end(whole, m)
            parts.append(whole[low : m.end()])
            at = sum(map(len, parts))
            keys[at - len(m[0])] = end
            cuts.append((at, end - m.end()))
            low = end
        text = "".join(parts) + whole[low:]
    open_parts = [] if setting else _continued(text, filename)
    found: list[tuple[int, int, bool]] = []
    a, shift, cut, part = 0, 0, 0, 0
    while a <= len(text):
        b = text.find("\n", a)
        b = len(text) if b < 0 else b
        while part < len(open_parts) and open_parts[part][1] <= a:
            part += 1
        inside = min(open_parts[part][1], b) - a if part < len(open_parts) and open_parts[part][0] < a else 0
        line = text[a:b]
        if inside or setting or _LITERAL.search(line):
            known = memory.get((line, setting, inside))
            if known is None:
                if len(memory) >= MEMORY:
                    memory.clear()
                known = memory[line, setting, inside] = labelled_line(line, setting, inside, crf)
            for s, e, begins in known:
                while cut < len(cuts) and cuts[cut][0] <= a + s:
                    shift += cuts[cut][1]
                    cut += 1
                if a + s in keys:
                    if keys[a + s] == a + e + shift and not _END.search(text, a + e):
                        continue  # a header alone is no key
                    found.append((a + s + shift, keys[a + s], True))
                else:
                    found.append((a + s + shift, a + e + shift, begins))
        a = b + 1
    return found


def _is_setting(name: str | None) -> bool:
    return bool(name) and name.lower().endswith(_SETTINGS_EXT)


def _hide(text: str, found: list[tuple[int, int, bool]]) -> str:
    out = list(text)
    for s, e, _ in found:
        for k in range(s, e):
            if out[k] not in "\r\n":
                out[k] = "*"
    return "".join(out)


def find_credentials(table: DataFrame, id_col: str = "id", source_col: str = "source", filename_col: str = "filename") -> DataFrame:
    """row_id, line_no: the lines on which a credential begins, each once."""
    narrow = table.select(F.col(id_col).alias("row_id"), F.col(filename_col).alias("file_name"), F.col(source_col).alias("file_text"))
    narrow = narrow.filter(F.col("file_text").isNotNull() & (F.col("file_text") != ""))
    kind = dict(narrow.dtypes)["row_id"]
    trained = model()
    parts = (trained.index, trained.weights, trained.steps)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = Crf(*parts)
        memory: dict = {}
        for f in frames:
            rows = []
            for i, name, text in zip(f["row_id"], f["file_name"], f["file_text"]):
                found = spans_of(text, _is_setting(name), crf, name, memory)
                rows += [(i, n) for n in sorted({text.count("\n", 0, s) + 1 for s, _, b in found if b})]
            yield pd.DataFrame(rows, columns=["row_id", "line_no"])

    return narrow.mapInPandas(run, f"row_id {kind}, line_no int")


def redact(table: DataFrame, id_col: str = "id", source_col: str = "source", filename_col: str = "filename") -> DataFrame:
    """row_id, the other columns, redacted, n_secrets of every row: the hidden characters are stars, everything else is
    unchanged, the length too; a null or empty text stays as it is, with no secrets."""
    trained = model()
    parts = (trained.index, trained.weights, trained.steps)

    @F.pandas_udf("redacted string, n_secrets int")
    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        crf = Crf(*parts)
        memory: dict = {}
        for names, texts in frames:
            rows = []
            for name, text in zip(names, texts):
                found = spans_of(text, _is_setting(name), crf, name, memory)
                rows.append((_hide(text, found) if found else text, sum(b for *_, b in found)))
            yield pd.DataFrame(rows, columns=["redacted", "n_secrets"])

    others = [c for c in table.columns if c not in (id_col, source_col)]
    return table.select(F.col(id_col).alias("row_id"), *others, run(F.col(filename_col), F.col(source_col)).alias("hidden")).select("row_id", *others, "hidden.redacted", "hidden.n_secrets")
