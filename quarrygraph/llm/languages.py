"""Problem 4: natural language hidden inside code.

Comments, documentation strings and string literals are cut into sentences; each word is broken into
the subwords of a public tokenizer and scored under unigram counts of eleven natural languages and of
an explicit code class; the class of the highest posterior names the sentence's language. The priors are
the classes' shares of all sentences of the table that is read. The counts are taken over all labelled documents: once over their whole prose, and once more over the sentences
that the first counts give to the document's own language, as documents mix languages. Every sentence
also counts without its accents, since texts in code often lack them.

Cases: null and empty texts give no rows; a sentence has at least three words (six characters of
Chinese or Japanese); identifiers, quoted code and numbers are no words; escapes of letters are
undone; a tie goes to the class that comes first in ``CLASSES``; repeated rows are rows of their own;
other columns are ignored; with empty tables the result is empty.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import language_of, skim
from .tokenizers import DIRECTORY, encoding

CLASSES = ("en", "code", "de", "fr", "es", "pt", "it", "nl", "pl", "ru", "ja", "zh")
TOKENIZER = "byte_bpe_50k"
SMOOTHING = 0.02  # share of the uniform distribution in every class, so that unseen subwords tell nothing
VOCABULARY_SHARE = 0.08  # share, in English, of the tokenizer's own whole words, by falling rank
VOCABULARY = 300_000  # words remembered in a process; beyond it the memory starts anew, results stay the same

_ESCAPE = re.compile(r"\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\U([0-9a-fA-F]{8})|&#(\d{2,6});|&#x([0-9a-fA-F]{2,5});")
_CODE_SPAN = re.compile(r"```[\s\S]*?(?:```|\Z)|`[^`\n]*`|\(\s*\w*(?:_|[a-z][A-Z])\w*\s*\)")
_IDENTIFIER = re.compile(r"\S*(?:\w_\w|[a-z][A-Z]|\d|[/\\@#=<>{}\[\]|~^$%]|::|\w\.\w)\S*")
_WORD = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ々ー]+|[^\W\d_぀-ヿ㐀-鿿]+(?:['’][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|(?<=[。！？；])|\n+|\\n|\\t|\|")
_MARK = re.compile(r"^[ \t]*(?:/\*+!?|\*+/?|//[/!]*|#+!?|--+|;+|\"{3}|'{3})?[ \t]*|[ \t]*\*/[ \t\r]*$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_GERMAN = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d"})


def unescape(text: str) -> str:
    """The text with its letters instead of their escapes; surrogate pairs are joined."""
    if "\\" not in text and "&#" not in text:
        return text

    def one(m: re.Match) -> str:
        h = m[1] or m[2] or m[3] or m[4] or m[6]
        n = int(h, 16) if h else int(m[5])
        return chr(n) if n < 0x110000 else m[0]

    out = _ESCAPE.sub(one, text)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if out is not text else out


def unaccented(text: str, german: bool = False) -> str:
    if text.isascii():
        return text
    if german:
        text = text.translate(_GERMAN)
    text = text.translate(_LETTERS)
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)) if not _CJK.search(text) else text


def _parts(text: str) -> Iterator[tuple[int, str, list[str]]]:
    """(begin, sentence, words) of a text without quoted code."""
    pos = 0
    for begin, end in [*(m.span() for m in _SENTENCE.finditer(text)), (len(text), len(text))]:
        piece, at, pos = text[pos:begin], pos, end
        part = _MARK.sub("", piece).strip(" \t\r\"'")
        if len(part) < 6:
            continue
        plain = _IDENTIFIER.sub(lambda m: m[0] if _CJK.search(m[0]) else " ", part)
        words = _WORD.findall(plain.lower())
        if len(words) >= 3 or (words and sum(len(w) for w in words if _CJK.match(w)) >= 6):
            yield at + piece.find(part), part, words


def sentences(text: str) -> Iterator[tuple[str, list[str]]]:
    """(sentence, words) of a text's sentences; quoted code and identifiers are left out of the words."""
    if "`" in text or "(" in text:
        text = _CODE_SPAN.sub(" ", text)
    for _, part, words in _parts(text):
        yield part, words


def _steps(rx: re.Pattern, text: str, widths: Callable[[re.Match], int]) -> tuple[list[int], list[int]]:
    """Places behind a replacement and the places before it that they come from, where the two begin to differ."""
    after, before, shift = [0], [0], 0
    for m in rx.finditer(text):
        width = widths(m)
        after += [m.start() - shift, m.start() - shift + width]
        before += [m.start(), m.end()]
        shift += len(m[0]) - width
    return after, before


def _back(steps: tuple[list[int], list[int]], place: int) -> int:
    i = bisect_right(steps[0], place) - 1
    return steps[1][i] + place - steps[0][i]


def placed_sentences(text: str) -> Iterator[tuple[int, str, int, list[str]]]:
    """(place, sentence, n_chars, words): the sentence as it stands there with the letters of its escapes and its quoted
    code, the character of the text at which it begins, and its length without quoted code."""
    plain = unescape(text)
    blank = _CODE_SPAN.sub(" ", plain) if "`" in plain or "(" in plain else plain
    escapes = spans = None
    for begin, part, words in _parts(blank):
        end = begin + len(part)
        if len(blank) != len(plain):
            spans = spans or _steps(_CODE_SPAN, plain, lambda m: 1)
            begin, end = _back(spans, begin), _back(spans, end - 1) + 1
        place = begin
        if len(plain) != len(text):
            # the second half of a surrogate pair adds no letter
            escapes = escapes or _steps(_ESCAPE, text, lambda m: 0 if m[2] and m[2][:2].lower() in ("dc", "dd", "de", "df") and re.search(r"\\u[dD][89abAB][0-9a-fA-F]{2}\Z", text[max(0, m.start() - 6) : m.start()]) else 1)
            place = _back(escapes, begin)
        yield place, plain[begin:end], len(part), words


class Scorer:
    """Log probabilities of words under the classes; the subwords of a word are taken once a process."""

    def __init__(self, logp: np.ndarray, directory: str, prior: np.ndarray | None = None):
        self.prior = np.zeros(len(CLASSES), np.float32) if prior is None else prior.astype(np.float32)
        self.logp, self.encode = logp, encoding(TOKENIZER, directory).encode_ordinary
        self.index: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.matrix = np.zeros((0, len(CLASSES)), np.float32)

    def ids(self, words: list[str]) -> list[int]:
        out = []
        for w in words:
            i = self.index.get(w)
            if i is None:
                i = self.index[w] = len(self.rows)
                self.rows.append(self.logp[self.encode(" " + w)].sum(0))
            out.append(i)
        return out

    def posterior(self, texts: list[list[str]]) -> np.ndarray:
        """Logarithms, but for a constant, of the posterior of each class for each list of words."""
        if not texts:
            return np.zeros((0, len(CLASSES)), np.float32)
        if len(self.index) > VOCABULARY:
            self.index, self.rows = {}, []
        ids = [self.ids(w) for w in texts]
        if len(self.matrix) != len(self.rows):
            self.matrix = np.array(self.rows, np.float32)
        starts = np.cumsum([0, *map(len, ids[:-1])])
        return np.add.reduceat(self.matrix[np.concatenate([np.array(x) for x in ids])], starts, axis=0) + self.prior

    def classify(self, texts: list[list[str]]) -> np.ndarray:
        """The class of the highest posterior of each list of words."""
        return self.posterior(texts).argmax(1)


def _token_counts(documents: DataFrame, directory: str, logp: np.ndarray | None, prior: np.ndarray | None, text_col: str, lang_col: str) -> pd.DataFrame:
    """language, token, n over all labelled documents; token -1 counts sentences, and spans of code. At most classes x vocabulary rows, whatever the input."""
    known = list(CLASSES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(TOKENIZER, directory).encode_ordinary
        scorer = Scorer(logp, directory, prior) if logp is not None else None
        said = Counter()
        words: dict[str, Counter] = {c: Counter() for c in CLASSES}
        for f in frames:
            for text, lang in zip(f["text"], f["lang"]):
                for m in re.finditer(r"```[\w]*\n([\s\S]*?)(?:```|\Z)|`([^`\n]+)`", text):
                    said["code"] += 1
                    words["code"].update(w for x in re.findall(r"[A-Za-z]+", m[1] or m[2]) for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", x.lower()))
                if lang not in words or lang == "code":
                    continue
                found = list(sentences(text))
                if scorer is not None and found:
                    kinds = scorer.classify([w for _, w in found])
                    found = [x for x, k in zip(found, kinds) if CLASSES[k] == lang]
                said[lang] += len(found)
                for part, ws in found:
                    words[lang].update(ws)
                    if lang != "en" and not part.isascii():
                        words[lang].update(unaccented(" ".join(ws)).split())
                        if lang == "de":
                            words[lang].update(unaccented(" ".join(ws), True).split())
        rows: dict[tuple[str, int], int] = {(g, -1): n for g, n in said.items()}
        for lang, c in words.items():
            for w, n in c.items():
                for t in encode(" " + w):
                    rows[lang, t] = rows.get((lang, t), 0) + n
        yield pd.DataFrame([(g, t, n) for (g, t), n in rows.items()], columns=["language", "token", "n"])

    narrow = documents.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isin(known))
    return narrow.mapInPandas(run, "language string, token int, n long").groupBy("language", "token").agg(F.sum("n").alias("n")).toPandas()


def train(documents: DataFrame, directory: str = DIRECTORY, text_col: str = "text", lang_col: str = "lang") -> tuple[np.ndarray, np.ndarray]:
    """(log probability of every token under every class, log prior of every class), from counts over all labelled documents."""
    enc = encoding(TOKENIZER, directory)
    size = enc.n_vocab
    extra = np.zeros((size, len(CLASSES)))
    for token, rank in enc._mergeable_ranks.items():
        if len(token) > 3 and token[:1] == b" " and token[1:].isalpha() and token.isascii():
            extra[rank, 0] += 1 / (rank + 500)
            for t in enc.encode_ordinary(token.decode().lower()):
                extra[t, 0] += 1 / (rank + 500)
    share = np.array([VOCABULARY_SHARE, *[0.0] * (len(CLASSES) - 1)])
    extra /= np.maximum(extra.sum(0), 1e-9)
    logp = prior = None
    for _ in range(2):
        counts, said = np.zeros((size, len(CLASSES))), np.ones(len(CLASSES))
        got = _token_counts(documents, directory, logp, prior, text_col, lang_col)
        whole = got[got["token"] < 0]
        said[[CLASSES.index(x) for x in whole["language"]]] += whole["n"].to_numpy(float)
        got = got[got["token"] >= 0]
        if len(got):
            np.add.at(counts, (got["token"].to_numpy(), [CLASSES.index(x) for x in got["language"]]), got["n"].to_numpy(float))
        p = counts / np.maximum(counts.sum(0), 1)
        logp = np.log((1 - SMOOTHING - share) * p + share * extra + SMOOTHING / size).astype(np.float32)
        prior = np.log(said / said.sum())
    return logp, prior


_BRACES = re.compile(r"[;{]\s*$", re.M)
_PY_HEAD = re.compile(r"^\s*(?:def|class)\s+\w+.*:\s*$", re.M)


def lexer_for(src: str, lang: str | None) -> str:
    """The lexer that fits the text, also where the file name misleads."""
    if lang in (None, "json") or lang in ("env", "yaml", "properties", "toml", "sh"):
        return "settings"
    if lang == "python":
        return "java" if not _PY_HEAD.search(src) and len(_BRACES.findall(src)) > 3 else lang
    return "python" if _PY_HEAD.search(src) and not _BRACES.search(src) else lang


def texts_of(src: str, lang: str | None) -> list[tuple[int, str]]:
    """(place, text) of the comments and literals of a source, consecutive line comments one text each."""
    kind = lexer_for(src, lang)
    k = skim(src, kind, False)
    out = []
    for s, e in k.comments:
        out.append((s, src[s:e]))
    for s, e in k.strings:
        if e - s > 6:  # a sentence has six characters at least, behind a quote
            out.append((s, src[s:e]))
    return out


def _narrow(table: DataFrame, id_col: str, text_col: str, filename_col: str | None) -> DataFrame:
    cols = [F.col(id_col).alias("row_id"), F.col(text_col).alias("own_text"), (F.col(filename_col) if filename_col else F.lit(None).cast("string")).alias("file_name")]
    return table.select(*cols).filter(F.col("own_text").isNotNull() & (F.col("own_text") != ""))


def priors(table: DataFrame, model: tuple[np.ndarray, np.ndarray], kind: str = "source", id_col: str = "id", text_col: str = "source", filename_col: str | None = "filename", directory: str = DIRECTORY) -> np.ndarray:
    """Log prior of every class in these texts: the mean posterior over all their sentences, starting from the model's prior
    (one step of expectation and maximisation). Texts in code hold far fewer sentences of other languages than documents do."""
    logp, start = model

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, total = Scorer(logp, directory, start), np.zeros(len(CLASSES))
        for f in frames:
            words = [ws for text, name in zip(f["own_text"], f["file_name"]) for _, t in _texts(text, name, kind) for _, ws in sentences(unescape(t))]
            x = scorer.posterior(words)
            x = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
            total += (x / x.sum(1, keepdims=True)).sum(0) if len(x) else 0
        yield pd.DataFrame({"class": range(len(CLASSES)), "n": total})

    got = _narrow(table, id_col, text_col, filename_col).mapInPandas(run, "class int, n double").groupBy("class").agg(F.sum("n").alias("n")).collect()
    total = np.ones(len(CLASSES))
    for c, n in got:
        total[c] += n
    return np.log(total / total.sum())


def _texts(text: str, name: str | None, kind: str) -> list[tuple[int, str]]:
    return texts_of(text, language_of(name)) if kind == "source" else [(0, text)]


def _walk(table: DataFrame, model: tuple[np.ndarray, np.ndarray], kind: str, id_col: str, text_col: str, filename_col: str | None, directory: str, shares: bool) -> DataFrame:
    narrow = _narrow(table, id_col, text_col, filename_col)
    logp, prior = model[0], priors(table, model, kind, id_col, text_col, filename_col, directory)
    id_type = dict(narrow.dtypes)["row_id"]
    columns = ["row_id", "lang", "n_sentences", "n_chars", "share"] if shares else ["row_id", "sentence", "place", "lang"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(logp, directory, prior)
        for f in frames:
            found, words = [], []
            for i, (text, name) in enumerate(zip(f["own_text"], f["file_name"])):
                for at, t in _texts(text, name, kind):
                    for place, sentence, n, ws in placed_sentences(t):
                        found.append((i, sentence, at + place, n))
                        words.append(ws)
            ids, whole = f["row_id"].tolist(), f["own_text"].str.len().tolist()
            kept = [(x, int(c)) for x, c in zip(found, scorer.classify(words)) if c != 1]
            if not shares:
                yield pd.DataFrame([(ids[i], sentence, place, CLASSES[c]) for (i, sentence, place, _), c in kept], columns=columns)
                continue
            total: dict[tuple[int, int], list[int]] = {}
            for (i, _, _, n), c in kept:
                x = total.setdefault((i, c), [0, 0])
                x[0] += 1
                x[1] += n
            yield pd.DataFrame([(ids[i], CLASSES[c], n, m, min(1.0, m / whole[i])) for (i, c), (n, m) in total.items()], columns=columns)

    return narrow.mapInPandas(run, f"row_id {id_type}, lang string, n_sentences long, n_chars long, share double" if shares else f"row_id {id_type}, sentence string, place int, lang string")


def text_sentences(table: DataFrame, model: tuple[np.ndarray, np.ndarray], kind: str = "source", id_col: str = "id", text_col: str = "source", filename_col: str | None = "filename", directory: str = DIRECTORY) -> DataFrame:
    """row_id, sentence, place, lang: a row for each sentence of each row's texts; place is the 0-based character of
    the text at which it begins. ``kind`` as for ``text_languages``."""
    return _walk(table, model, kind, id_col, text_col, filename_col, directory, False)


def text_languages(table: DataFrame, model: tuple[np.ndarray, np.ndarray], kind: str = "source", id_col: str = "id", text_col: str = "source", filename_col: str | None = "filename", directory: str = DIRECTORY) -> DataFrame:
    """row_id, lang, n_sentences, n_chars, share: a row for each language of each row's texts, added up from the same
    sentences; share is the part of the whole text's characters. ``kind`` "source" reads the comments and literals
    of a file, "text" reads the column as one text."""
    return _walk(table, model, kind, id_col, text_col, filename_col, directory, True)
