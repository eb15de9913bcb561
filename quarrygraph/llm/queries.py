"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import bounded_batches, table
from . import credentials, encoding, functions, languages, mixing, near, provenance, syntax, truncation

SQL: dict[str, str] = {}


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    bounded_batches(spark)
    return functions.pair_entities(table(spark, base, "entity")).select("entity_id")


def p1_pairs(spark: SparkSession, base: str) -> DataFrame:
    bounded_batches(spark)
    return functions.extract_functions(table(spark, base, "sourcecode"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    bounded_batches(spark)
    return syntax.find_unparsable(table(spark, base, "sourcecode")).selectExpr("id AS source_id")


def p2_rates(spark: SparkSession, base: str) -> DataFrame:
    bounded_batches(spark)
    return syntax.unparsable_rates(table(spark, base, "sourcecode"))


def _similar(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    bounded_batches(spark)
    return near.similar_pairs(table(spark, base, "entity").filter("type = 'function'"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return near.all_pairs(*_similar(spark, base)).selectExpr("id_a AS entity_id_a", "id_b AS entity_id_b")


def p3_groups(spark: SparkSession, base: str) -> DataFrame:
    return near.groups(*_similar(spark, base)).withColumnRenamed("rid", "entity_id")


def p3_links(spark: SparkSession, base: str) -> DataFrame:
    """The pairs between representatives alone, with their similarity; p3_groups has the members of each."""
    return _similar(spark, base)[1].selectExpr("ra AS entity_id_a", "rb AS entity_id_b", "similarity")


def _languages(spark: SparkSession, base: str, operator: Callable[..., DataFrame] = languages.text_languages) -> DataFrame:
    bounded_batches(spark)
    model = languages.train(table(spark, base, "documents"))
    files = operator(table(spark, base, "sourcecode"), model)
    comments = operator(table(spark, base, "entity"), model, kind="text", text_col="comment", filename_col=None)
    return files.selectExpr("'sourcecode' AS origin", "*").unionByName(comments.selectExpr("'entity' AS origin", "*"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return _languages(spark, base).filter("lang <> 'en'").select("origin", "row_id", "lang")


def p4_sentences(spark: SparkSession, base: str) -> DataFrame:
    """Every sentence of both tables' texts with its language, English too."""
    return _languages(spark, base, languages.text_sentences)


def p4_share(spark: SparkSession, base: str) -> DataFrame:
    return _languages(spark, base)


def _produced(spark: SparkSession, base: str) -> DataFrame:
    bounded_batches(spark)
    return provenance.produced_files(table(spark, base, "sourcecode"), table(spark, base, "library_file"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return _produced(spark, base).filter("produced").selectExpr("file_id AS source_id")


def p5_handwritten(spark: SparkSession, base: str) -> DataFrame:
    return _produced(spark, base).filter("NOT produced").selectExpr("file_id AS source_id", "score")


def _credentials(spark: SparkSession, base: str) -> DataFrame:
    return (
        credentials.find_credentials(table(spark, base, "sourcecode")).selectExpr("'sourcecode' AS origin", "row_id", "line_no")
        .unionByName(credentials.find_credentials(table(spark, base, "entity")).selectExpr("'entity' AS origin", "row_id", "line_no"))
    )


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    bounded_batches(spark)
    return _credentials(spark, base)


def p7_redacted(spark: SparkSession, base: str) -> DataFrame:
    """Every row of both tables with its text redacted; a column that one table lacks is null there."""
    bounded_batches(spark)
    files = credentials.redact(table(spark, base, "sourcecode")).selectExpr("'sourcecode' AS origin", "*")
    return files.unionByName(credentials.redact(table(spark, base, "entity")).selectExpr("'entity' AS origin", "*"), allowMissingColumns=True)


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    bounded_batches(spark)
    return encoding.encode(table(spark, base, "documents"))


def p8_decoded(spark: SparkSession, base: str) -> DataFrame:
    """The texts back from their ids, beside the stored ones."""
    bounded_batches(spark)
    docs = table(spark, base, "documents")
    back = encoding.decode(encoding.encode(docs)).withColumnRenamed("text", "decoded")
    return docs.select("doc_id", "text").join(back, "doc_id").selectExpr("doc_id", "decoded", "decoded = coalesce(text, '') AS same")


def _mix(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    bounded_batches(spark)
    return mixing.mix(encoding.count_tokens(table(spark, base, "documents")), table(spark, base, "mix_target"))


def p9_mix(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[0]


def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[1]


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return truncation.flag_truncated(table(spark, base, "documents")).filter("truncated").select("doc_id")


def p10_rates(spark: SparkSession, base: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, base, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p3_links": p3_links,
    "p4_found": p4_found,
    "p4_sentences": p4_sentences,
    "p4_share": p4_share,
    "p5_found": p5_found,
    "p5_handwritten": p5_handwritten,
    "p7_found": p7_found,
    "p7_redacted": p7_redacted,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}

SQL["p3_found"] = """WITH w AS (SELECT id, unnest(list_distinct(regexp_extract_all(source, '[A-Za-z0-9_]+'))) AS word FROM entity WHERE type = 'function' AND source IS NOT NULL),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id HAVING count(*) >= 30),
k AS (SELECT w.id, w.word, n.n FROM w JOIN n ON n.id = w.id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS s, any_value(a.n) + any_value(b.n) AS u FROM k a JOIN k b ON a.word = b.word AND a.id < b.id AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) GROUP BY a.id, b.id)
SELECT a AS entity_id_a, b AS entity_id_b FROM p WHERE s >= 0.7 * (u - s)"""
_LINKS = """w AS (SELECT id, list_sort(list_distinct(regexp_extract_all(source, '[A-Za-z0-9_]+'))) AS words FROM entity WHERE type = 'function' AND source IS NOT NULL),
s AS (SELECT id, min(id) OVER (PARTITION BY words) AS rep, words FROM w WHERE len(words) >= 30),
k AS (SELECT id, unnest(words) AS word, len(words) AS n FROM s WHERE id = rep),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS s, any_value(a.n) + any_value(b.n) AS u FROM k a JOIN k b ON a.word = b.word AND a.id < b.id AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) GROUP BY a.id, b.id HAVING count(*) >= 0.7 * (any_value(a.n) + any_value(b.n) - count(*)))"""
SQL["p3_links"] = f"WITH {_LINKS} SELECT a AS entity_id_a, b AS entity_id_b, s / (u - s)::DOUBLE AS similarity FROM p"
SQL["p3_groups"] = f"""WITH RECURSIVE {_LINKS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT rep AS x, rep AS y FROM s UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
c AS (SELECT x, min(y) AS class_id FROM r GROUP BY x), d AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT s.id AS entity_id, c.class_id, coalesce(d.n_links, 0) AS n_links FROM s JOIN c ON c.x = s.rep LEFT JOIN d ON d.a = s.rep"""
SQL["p8_decoded"] = "SELECT doc_id, coalesce(text, '') AS decoded, true AS same FROM documents"
