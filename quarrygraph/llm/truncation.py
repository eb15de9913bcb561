"""Problem 10: texts cut off by field limits or broken transfers.

In pure SQL: every text becomes a row of tokens, once (words, single Chinese or Japanese characters, marks, line
ends; addresses, identifiers and numbers each as one sign). Over all texts, word trigrams, pairs and single
words are counted inside lines and at their ends. A text's last trigram is joined to these counts, backing
off to the pair where it is too rare; words that are frequent inside but almost never at an end
show a cut. So does a last word found nowhere else behind a pair that never ends but one word later, a
fragment without an end behind a full stop on the same line, and one on a line whose first word begins lines
that nearly always end in a full stop. What cutting tools leave at the cut (a mark, a
count, a broken character) is taken off first, and a text that carries it is cut unless a whole sentence
stands before a mere ellipsis. ``reason`` names the first of these that holds: mark, trigram, pair, word, fragment, line.

Cases: null, empty and blank texts are not cut; a text that ends in a full stop, a closed code block, a
list item, a field, an address or a signature is whole, whatever its length; repeated texts are each
flagged; repeated ids give repeated rows, cut if any of them is; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rounds import stored

ENOUGH = 4  # times that a trigram, pair or word must occur to be judged by
RARELY = 0.03  # share of a token sequence's occurrences at an end, up to which it shows a cut
MOSTLY = 0.8  # share of the lines with the same first word that end in a full stop, from which an open one is cut

# fixed values: what tools leave at a cut; a run of blanks is tried once only, so that no text takes long
MARK = r"(?<!\s)(?:\s*+(?:\[(?:\.\.\.|…|truncated|cut|clipped|snip(?:ped)?|more|\+\s*\d+ (?:more )?(?:chars?|characters|bytes|words|lines))\]|\((?:message |text |output )?(?:clipped|truncated|cut off|continued|\+\s*\d+ (?:more )?(?:chars?|characters))\)|<(?:more|truncated|clipped|snip|cut)>|(?:read|see|show) more|�++))+\s*+$"
ELLIPSIS = r"(?<![\s.…])\s*+(?:…|\.\.\.++)\s*+$"
FIRST = r"^\s*+(`[^`\n]*` [\p{L}]+|[\p{L}]+|[぀-ヿ㐀-鿿])"
_SENTENCE_END = r"[.!?。！？][)\"”’»'`*]*+$"
# signs for addresses, identifiers, numbers and line ends, then blanks around whatever is no word
_SIGNS = (
    (r"https?://\S+", " \u0003 "),
    (r"`[^`\n]*`|(?<![A-Za-z0-9])[A-Za-z0-9]*+_\w++|(?<!\p{L})\p{L}*?[a-z][A-Z]\p{L}*+", " \u0002 "),
    (r"[0-9]+", " 9 "),
    (r"\n\s*+", " \u0001 "),
    (r"([぀-ヿ㐀-鿿]|[^\s\p{L}\p{M}\p{N}])", " $1 "),
)


def _q(text: str) -> str:
    """The text as an SQL literal."""
    return "r'" + text.replace("'", "\\u0027") + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tokens(body: str) -> str:
    for pattern, sign in _SIGNS:
        body = f"regexp_replace({body}, {_q(pattern)}, '{sign}')"
    return f"split(concat('^ ^ ', lower(trim({body})), ' $'), '\\\\s+')"


def flag_truncated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, truncated, reason of every row."""
    spark, tag, views = documents.sparkSession, uuid.uuid4().hex[:12], []

    def view(name: str, df: DataFrame) -> str:
        views.append(f"{name}_{tag}")
        df.createOrReplaceTempView(views[-1])
        return views[-1]

    docs = view("documents", documents.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text", f"`{source_col}` AS source"))
    bodies = view("bodies", stored(spark.sql(f"""
        WITH trimmed AS (
            SELECT doc_id, rtrim(' \\n\\r\\t', text) AS text FROM {docs} WHERE text IS NOT NULL AND trim(text) <> ''
        ), bare AS (
            SELECT doc_id, mark <> '' AS marked, left(text, length(text) - length(mark)) AS body0
            FROM (SELECT doc_id, text, regexp_extract(text, {_q(MARK)}, 0) AS mark FROM trimmed)
        ), ready AS (
            SELECT doc_id, marked, left(body0, length(body0) - length(regexp_extract(body0, {_q(ELLIPSIS)}, 0))) AS body FROM bare
        ), lined AS (
            SELECT doc_id, marked, split(body, '\\n') AS lines, {_tokens("body")} AS t FROM ready
        )
        SELECT doc_id, marked, t, element_at(lines, -1) AS last_line,
               transform(slice(lines, 1, size(lines) - 1), l -> struct(lower(regexp_extract(l, {_q(FIRST)}, 1)) AS first, rtrim(l) RLIKE {_q(_SENTENCE_END)} AS stopped)) AS earlier
        FROM lined
    """), "truncation-bodies"))
    # the tokens after the one counted tell whether it ends a line, or the next one does
    counts = view("counts", stored(spark.sql(f"""
        SELECT k3, k2, k1, count(*) AS n, count_if(z1 IN ('\u0001', '$')) AS ends, count_if(z2 IN ('\u0001', '$') AND NOT z1 IN ('\u0001', '$')) AS ends_next
        FROM (
            SELECT xxhash64(a, b, c) AS k3, xxhash64(b, c) AS k2, xxhash64(c) AS k1, z1, coalesce(z2, '') AS z2
            FROM (SELECT inline(arrays_zip(slice(t, 1, size(t) - 3), slice(t, 2, size(t) - 3), slice(t, 3, size(t) - 3), slice(t, 4, size(t) - 3), slice(t, 5, size(t)))) AS (a, b, c, z1, z2) FROM {bodies} WHERE size(t) > 3)
            WHERE c <> '\u0001'
        ) GROUP BY k3, k2, k1
    """), "truncation-counts"))
    out = spark.sql(f"""
        WITH last AS (
            SELECT doc_id, marked, last_line, element_at(t, -4) AS a, element_at(t, -3) AS b, element_at(t, -2) AS c,
                   last_line RLIKE {_q(_SENTENCE_END)} AS stopped, lower(regexp_extract(last_line, {_q(FIRST)}, 1)) AS first
            FROM {bodies} WHERE size(t) > 3
        ),
        open AS (
            SELECT doc_id, xxhash64(a, b, c) AS k3, xxhash64(b, c) AS k2, xxhash64(c) AS k1, xxhash64(a, b) AS before, first,
                   last_line RLIKE '[.!?]["”)]?\\\\s+\\\\S+|[。！？].' AND NOT last_line RLIKE '^\\\\s*+(?:[-*+] |[0-9]+[.)] |[:@][a-z]+ |[|>#])' AS fragment
            FROM last WHERE NOT stopped AND NOT last_line RLIKE '^\\\\s*+(?:`{{3}}|~{{3}})' AND NOT last_line RLIKE '(?::[-]?[)D(]|;[-]?[)])$'
        ),
        c3 AS (SELECT k3, n, ends FROM {counts} WHERE n >= {ENOUGH}),
        c2 AS (SELECT k2, sum(n) AS n, sum(ends) AS ends, sum(ends_next) AS ends_next FROM {counts} GROUP BY k2),
        c1 AS (SELECT k1, sum(n) AS n, sum(ends) AS ends FROM {counts} GROUP BY k1),
        firsts AS (
            SELECT e.first AS first, count(*) AS n, count_if(e.stopped) AS stops FROM {bodies} LATERAL VIEW explode(earlier) AS e
            WHERE e.first <> '' GROUP BY e.first HAVING count(*) >= {ENOUGH}
        ),
        judged AS (
            SELECT open.doc_id, CASE
                WHEN c3.ends / c3.n <= {RARELY} THEN 2
                WHEN c3.n IS NULL AND c2.n >= {ENOUGH} AND c2.ends / c2.n <= {RARELY} THEN 3
                WHEN coalesce(c1.n - c1.ends, 0) = 0 AND p2.n >= {ENOUGH} AND (p2.ends + p2.ends_next) / p2.n <= {RARELY} THEN 4
                WHEN fragment THEN 5
                WHEN f.stops >= {MOSTLY} * f.n THEN 6 END AS why
            FROM open
            LEFT JOIN c3 ON c3.k3 = open.k3
            LEFT JOIN c2 ON c2.k2 = open.k2
            LEFT JOIN c1 ON c1.k1 = open.k1
            LEFT JOIN firsts f ON f.first = open.first
            LEFT JOIN c2 AS p2 ON p2.k2 = open.before
        ),
        found AS (
            SELECT doc_id, min(why) AS why FROM (SELECT doc_id, why FROM judged WHERE why IS NOT NULL UNION ALL SELECT doc_id, 1 FROM {bodies} WHERE marked AND size(t) > 3) GROUP BY doc_id
        )
        SELECT d.doc_id, d.source, f.why IS NOT NULL AS truncated, CASE f.why WHEN 1 THEN 'mark' WHEN 2 THEN 'trigram' WHEN 3 THEN 'pair' WHEN 4 THEN 'word' WHEN 5 THEN 'fragment' WHEN 6 THEN 'line' END AS reason
        FROM {docs} d LEFT JOIN found f ON d.doc_id = f.doc_id
    """)
    for name in views:  # the plan holds what they stand for
        spark.catalog.dropTempView(name)
    return out


def truncation_rates(documents: DataFrame, **names) -> DataFrame:
    """source, texts, truncated, by_mark, by_trigram, by_other, rate; a null source is a group of its own."""
    flags = flag_truncated(documents, **names)
    by = [F.count_if(F.col("reason") == "mark").alias("by_mark"), F.count_if(F.col("reason") == "trigram").alias("by_trigram"), F.count_if(~F.col("reason").isin("mark", "trigram")).alias("by_other")]
    return flags.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("truncated").alias("truncated"), *by).withColumn("rate", F.col("truncated") / F.col("texts"))
