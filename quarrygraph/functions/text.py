"""Scalar expressions over source text; every one stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: decision points that count one each, by language; other languages count as c
DECISIONS = {
    "c": [r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bswitch\s*\(", r"\bcase\s+", r"\?\s*.*:", r"&&", r"\|\|", r"\bcatch\s*\("],
    "javascript": [r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bfor\s*\(", r"\bfor\s+of\b", r"\bfor\s+in\b", r"\bwhile\s*\(", r"\bswitch\s*\(", r"\bcase\s+", r"\?\s*.*:", r"&&", r"\|\|", r"\?\?", r"\bcatch\s*\(", r"\.catch\s*\("],
    "python": [r"\bif\s+", r"\belif\s+", r"\bfor\s+", r"\bwhile\s+", r"\band\b", r"\bor\b", r"\bexcept\s*", r"\bif\s+.*\s+else\s+"],
}


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded to digits, halves towards plus infinity."""
    p = 10**digits
    return F.floor(x * p + F.lit(0.5)) / F.lit(float(p))


def count(source: Column, pattern: str) -> Column:
    return F.regexp_count(source, F.lit(pattern))


def cyclomatic(source: Column, language: Column) -> Column:
    """One and the number of decision points; one for a null source."""

    def total(patterns: list[str]) -> Column:
        out = F.lit(1)
        for p in patterns:
            out = out + count(source, p)
        return out

    by = F.when(language == "python", total(DECISIONS["python"])).when(language == "javascript", total(DECISIONS["javascript"])).otherwise(total(DECISIONS["c"]))
    return F.when(source.isNull() | (source == ""), F.lit(1)).otherwise(by)


def nesting(source: Column) -> Column:
    """The deepest brace level, closing braces never below zero; by indentation where there is no brace."""
    marks = F.split(F.regexp_replace(source, r"[^{}]", ""), "")
    state = F.aggregate(
        marks, F.lit(0).cast("long"),
        lambda acc, x: (lambda cur: F.greatest(F.floor(acc / 100000), cur) * 100000 + cur)(F.greatest(acc % 100000 + F.when(x == "{", 1).when(x == "}", -1).otherwise(0), F.lit(0))),
    )
    lead = F.transform(F.filter(F.split(source, "\n"), lambda x: F.trim(x) != ""), lambda x: F.length(F.regexp_extract(x, r"^(\s*)", 1)))
    depths = F.transform(lead, lambda n: F.when(n >= 4, F.floor(n / 4)).otherwise(F.floor(n / 2)))
    flat = F.coalesce(F.array_max(depths), F.lit(0))
    return F.when(source.isNull() | (source == ""), F.lit(0)).when(F.instr(source, "{") > 0, F.floor(state / 100000)).otherwise(flat).cast("int")


def lines_of_code(source: Column) -> Column:
    """Lines that are neither blank nor begin a comment."""
    lines = F.filter(F.split(source, "\n"), lambda x: ~F.regexp_like(x, F.lit(r"^\s*(?://|#|\*|/\*|\z)")))
    return F.when(source.isNull() | (source == ""), F.lit(0)).otherwise(F.size(lines))


def parameter_count(parameters: Column) -> Column:
    """Commas outside brackets and one; none for null, () and (void)."""
    inner = F.trim(F.regexp_replace(F.regexp_replace(parameters, r"^\(", ""), r"\)\z", ""))
    marks = F.split(F.regexp_replace(inner, r"[^<>()\[\],]", ""), "")
    state = F.aggregate(
        marks, F.lit(100000001).cast("long"),
        lambda acc, x: F.when(x.isin("<", "(", "["), acc + 100000).when(x.isin(">", ")", "]"), acc - 100000).when((x == ",") & (F.floor(acc / 100000) == 1000), acc + 1).otherwise(acc),
    )
    return F.when(parameters.isNull() | parameters.isin("", "()") | inner.isin("", "void"), F.lit(0)).otherwise((state % 100000).cast("int"))


def rating(cc: Column) -> Column:
    return F.when(cc <= 5, "low").when(cc <= 10, "moderate").when(cc <= 20, "high").otherwise("very_high")


def normalized(source: Column) -> Column:
    """Without line, block and hash comments, white space collapsed, lower case."""
    s = F.regexp_replace(source, r"(?m)//.*$", "")
    s = F.regexp_replace(s, r"/\*[\s\S]*?\*/", "")
    s = F.regexp_replace(s, r"(?m)#.*$", "")
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def tokens(source: Column) -> Column:
    """The distinct words of more than two characters of the normalized source."""
    return F.array_distinct(F.filter(F.split(normalized(source), r"\s+"), lambda x: F.length(x) > 2))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the words, each with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    shared = F.size(F.array_intersect(x, y))
    return F.when(F.size(x) + F.size(y) == 0, F.lit(0.0)).otherwise(shared / (F.size(x) + F.size(y) - shared))


def most_jaccard(a: Column, b: Column, threshold: float) -> Column:
    """Whether sets of these sizes can reach the threshold; an empty one can't."""
    return F.when((a == 0) | (b == 0), F.lit(False)).otherwise(F.least(a, b) / F.greatest(a, b) >= threshold)


def string_hash(text: Column, seed: int = 0) -> Column:
    """h = 31 h + c over the characters, from the seed, modulo 2 to the 32."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(seed).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % 4294967296)


def minhash_signature(tokens: Column, size: int = 64, step: int = 31337) -> Column:
    """For each of ``size`` seeds (multiples of step) the least hash of the tokens. The hash is linear in its seed, so each
    token is walked once, not once a seed: hash(seed) = seed * 31 ** length + hash(0)."""
    power = lambda w: F.aggregate(F.sequence(F.lit(1), F.length(w)), F.lit(1).cast("long"), lambda p, _: (p * 31) % 4294967296)
    walked = F.transform(tokens, lambda w: F.struct(string_hash(w).alias("h"), power(w).alias("p")))
    seeds = F.array(*[F.lit(i * step).cast("long") for i in range(size)])
    # the one-element array binds what was walked, which the seeds would walk again each
    return F.transform(F.array(walked), lambda ws: F.transform(seeds, lambda s: F.array_min(F.transform(ws, lambda x: (s * x["p"] + x["h"]) % 4294967296))))[0]


def minhash_estimate(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures; 0 for empty ones or of different lengths."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise(equal / F.size(a))


def identifier_words(name: Column) -> Column:
    """The words of an identifier: before capitals, at underscores and hyphens."""
    return F.filter(F.split(name, "(?=[A-Z])|_|-"), lambda w: w != "")


def to_fixed(x: Column, digits: int) -> Column:
    """The number as text with so many digits."""
    return F.format_string(f"%.{digits}f", half_up(x, digits))
