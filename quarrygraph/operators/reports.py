"""Reports over findings and metrics: rollups, top lists with their truncation told, summaries of a project, and the cached
dashboard. Every list is a ranked row set, so no group is ever gathered whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import codegraph as G


def top_rows(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group with their rank, the size of the group and whether it goes on."""
    total = df.groupBy(*by).agg(F.count("*").alias("total"))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= limit)
    return ranked.join(total, by).withColumn("truncated", F.col("total") > limit)


def with_place(findings: DataFrame, entity: DataFrame) -> DataFrame:
    """Findings with the symbol, file, line and language of their function."""
    return findings.join(entity.select("id", "symbol", "filename", "start_line", "language"), "id")


def findings_by(findings: DataFrame, entity: DataFrame, by: list[str]) -> DataFrame:
    """Numbers of findings and of functions that have any, by project and the columns named, such as language or category."""
    placed = with_place(findings, entity)
    return placed.groupBy("project_id", *by).agg(F.count("*").alias("findings"), F.countDistinct("id").alias("functions"), F.countDistinct("filename").alias("files"))


def finding_places(findings: DataFrame, entity: DataFrame, kind: list[str], limit: int = 20) -> DataFrame:
    """Of each project and kind the first ``limit`` places by file and line, with the number of all and whether there are more."""
    placed = with_place(findings, entity)
    rows = top_rows(placed, ["project_id", *kind], [F.col("filename").asc_nulls_first(), F.col("start_line").asc_nulls_first(), F.col("id")], limit)
    return rows.select("project_id", *kind, "total", "truncated", "rank", "id", "symbol", "filename", "start_line")


def share_of_functions(findings: DataFrame, entity: DataFrame) -> DataFrame:
    """Each project's functions, those with findings, their share in percent to one digit, and the findings."""
    n = G.functions_of(entity).groupBy("project_id").agg(F.count("*").alias("functions"))
    g = findings.groupBy("project_id").agg(F.countDistinct("id").alias("with_findings"), F.count("*").alias("findings"))
    return n.join(g, "project_id", "left").fillna(0).withColumn("percentage", T.half_up(F.col("with_findings") / F.col("functions") * 100, 1))


def top_functions(metrics: DataFrame, limit: int = 20) -> DataFrame:
    """Each project's most complex and its largest functions."""
    parts = []
    for name, column in (("complexity", "cyclomatic"), ("size", "loc")):
        rows = top_rows(metrics.withColumn("value", F.col(column).cast("long")), ["project_id"], [F.col("value").desc(), F.col("id")], limit)
        parts.append(rows.select("project_id", F.lit(name).alias("list"), "rank", "id", "symbol", "value", "truncated"))
    return reduce(DataFrame.unionByName, parts)


def readability_extremes(scores: DataFrame, limit: int = 10) -> DataFrame:
    """Each project's least and most readable functions, by the score that also weighs their length."""
    scores, parts = scores.withColumn("score", F.col("combined_score")), []
    for name, order in (("worst", F.col("score").asc()), ("best", F.col("score").desc())):
        rows = top_rows(scores.select("id", "project_id", "score"), ["project_id"], [order, F.col("id")], limit)
        parts.append(rows.select("project_id", F.lit(name).alias("list"), "rank", "id", "score"))
    return reduce(DataFrame.unionByName, parts)


def readability_by_project(scores: DataFrame) -> DataFrame:
    """Each project's average score and the numbers of its functions by rating."""
    ratings = ("excellent", "good", "acceptable", "poor", "very_poor")
    s = F.col("combined_score")
    rating = F.when(s >= 85, ratings[0]).when(s >= 70, ratings[1]).when(s >= 55, ratings[2]).when(s >= 40, ratings[3]).otherwise(ratings[4])
    scores = scores.select("project_id", s.alias("score"), rating.alias("rating"))
    return scores.groupBy("project_id").agg(F.count("*").alias("functions"), T.half_up(F.avg("score"), 0).cast("long").alias("average"), *[F.count_if(F.col("rating") == x).alias(x) for x in ratings])


def smell_density(smells: DataFrame, entity: DataFrame) -> DataFrame:
    """Each project's smells by severity, and how many there are to a hundred functions, to one digit."""
    n = G.functions_of(entity).groupBy("project_id").agg(F.count("*").alias("functions"))
    g = smells.groupBy("project_id").agg(F.count("*").alias("smells"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))
    return n.join(g, "project_id", "left").fillna(0).withColumn("density", T.half_up(F.col("smells") / F.col("functions") * 100, 1))


def duplication_share(pairs: DataFrame, entity: DataFrame) -> DataFrame:
    """Each project's pairs of near copies, the functions in any, and their share of its functions in percent."""
    n = G.functions_of(entity).groupBy("project_id").agg(F.count("*").alias("functions"))
    ids = G.functions_of(entity).select("id", "project_id")
    ends = pairs.select(F.col("id_a").alias("id"), F.lit(1).alias("first")).unionByName(pairs.select(F.col("id_b").alias("id"), F.lit(0).alias("first")))
    g = ends.join(ids, "id").groupBy("project_id").agg(F.sum("first").alias("pairs"), F.countDistinct("id").alias("duplicated"))
    return n.join(g, "project_id", "left").fillna(0).withColumn("percentage", T.half_up(F.col("duplicated") / F.col("functions") * 100, 1))


def api_summary(surface: DataFrame) -> DataFrame:
    """Each project's public and private functions, entry points, undocumented public ones, and average number of parameters."""
    return surface.groupBy("project_id").agg(
        F.count_if(~F.col("is_private")).alias("public"), F.count_if("is_private").alias("private"), F.count_if("entry_point").alias("entry_points"), F.count_if(~F.col("is_private") & ~F.col("documented")).alias("undocumented"),
        T.half_up(F.count_if(~F.col("is_private") & F.col("documented")) / F.count_if(~F.col("is_private")) * 100, 1).alias("documented_pct"), T.half_up(F.avg(F.when(~F.col("is_private"), F.col("params"))), 1).alias("avg_params"),
    )


def scope_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("project_id", "issue").agg(F.count("*").alias("functions"), F.sum("n").alias("occurrences"))


def file_analytics(metrics: DataFrame, entity: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """(files, top): of each file its entities by type, the averages, least and greatest of its functions' measures, averages
    also as text of two digits; and its most complex functions."""
    kinds = entity.groupBy("project_id", "filename").agg(*[F.count_if(F.col("type") == k).alias(f"{k}_count") for k in ("function", "class", "struct")])
    m = metrics.groupBy("project_id", "filename").agg(
        T.half_up(F.avg("cyclomatic"), 2).alias("avg_cyclomatic"), F.min("cyclomatic").alias("min_cyclomatic"), F.max("cyclomatic").alias("max_cyclomatic"),
        T.half_up(F.avg("loc"), 2).alias("avg_loc"), F.min("loc").alias("min_loc"), F.max("loc").alias("max_loc"), T.half_up(F.avg("params"), 2).alias("avg_params"), F.max("nesting").alias("max_nesting"),
    )
    files = kinds.join(m, ["project_id", "filename"]).withColumn("avg_text", F.format_string("%.2f", "avg_cyclomatic"))
    rows = top_rows(metrics, ["project_id", "filename"], [F.col("cyclomatic").desc(), F.col("id")], top)
    return files, rows.select("project_id", "filename", "rank", "id", "symbol", "cyclomatic", "truncated")


def light_counts(entity: DataFrame) -> DataFrame:
    """Each project's functions, classes, files, languages, commented functions and test files in one pass."""
    test = F.col("filename").ilike("%test%") | F.col("filename").ilike("%spec%")
    return entity.groupBy("project_id").agg(
        F.count_if(F.col("type") == "function").alias("functions"), F.count_if(F.col("type").isin("class", "struct")).alias("classes"), F.countDistinct("filename").alias("files"), F.countDistinct("language").alias("languages"),
        F.count_if((F.col("type") == "function") & F.coalesce(F.col("comment") != "", F.lit(False))).alias("commented"), F.countDistinct(F.when(test, F.col("filename"))).alias("test_files"),
    )


# ---------------------------------------------------------------- classes


def hierarchy_summary(entity: DataFrame, inheritance: DataFrame, trees: DataFrame) -> DataFrame:
    """Each project's classes and their relations: roots (no parent row), leaves (nobody's parent), abstract ones, relations by
    type, children to a class, and the greatest depth with the class of the least id that has it. trees: node_id, depth
    of ``forest`` over the rows that extend; nodes on or below a circle have no depth."""
    c = entity.filter(F.col("type").isin("class", "struct")).select("id", "project_id", F.coalesce("is_abstract", F.lit(False)).alias("abstract"), "symbol")
    kids = inheritance.filter("child_entity_id IS NOT NULL").select(F.col("child_entity_id").alias("id"), F.lower(F.trim("relationship_type")).alias("kind"))
    child, parent = kids.select("id", F.lit(True).alias("child")).distinct(), inheritance.filter("parent_entity_id IS NOT NULL").select(F.col("parent_entity_id").alias("id"), F.lit(True).alias("parent")).distinct()
    d = trees.filter("depth >= 0").select(F.col("node_id").alias("id"), "depth")
    m = c.join(child, "id", "left").join(parent, "id", "left").join(d, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    per = m.groupBy("project_id").agg(
        F.count("*").alias("classes"), F.count_if(F.col("child").isNull()).alias("roots"), F.count_if(F.col("parent").isNull()).alias("leaves"), F.count_if("abstract").alias("abstract_classes"),
        F.max("depth").alias("max_depth"), F.min(F.struct((-F.col("depth")).alias("d"), "id", "symbol")).alias("deep"),
    )
    r = kids.join(c.select("id", "project_id"), "id").groupBy("project_id").agg(F.count("*").alias("relations"), *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("extends", "implements", "embeds")])
    out = per.join(r, "project_id", "left").fillna(0, ["relations", "extends_count", "implements_count", "embeds_count"])
    return out.withColumn("children_per_class", T.half_up(F.col("relations") / F.col("classes"), 1)).withColumn("deepest_class", F.when(F.col("max_depth") > 0, F.col("deep.id"))).drop("deep")


def class_tree(inheritance: DataFrame, roots: DataFrame, direction: str = "both", max_depth: int = 10) -> DataFrame:
    """(root_id, direction, depth, class_id, relationship_type): the classes above and below each root (node) over rows of any
    type, each with its least depth and, of several types on the last step, the first. A circle ends where it closes."""
    e = inheritance.filter("child_entity_id IS NOT NULL AND parent_entity_id IS NOT NULL").select(F.col("child_entity_id").alias("child"), F.col("parent_entity_id").alias("parent"), F.lower(F.trim("relationship_type")).alias("kind")).distinct()
    parts = []
    for name, near, far in (("up", "child", "parent"), ("down", "parent", "child")):
        if direction not in (name, "both"):
            continue
        seen = G.cut(roots.select(F.col("node").alias("root_id"), F.col("node").alias("class_id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("relationship_type")))
        front = seen
        for d in range(1, max_depth + 1):
            step = e.join(front.select("root_id", F.col("class_id").alias(near)), near).groupBy("root_id", F.col(far).alias("class_id")).agg(F.min("kind").alias("relationship_type"))
            front = G.cut(step.join(seen.select("root_id", "class_id"), ["root_id", "class_id"], "left_anti").select("root_id", "class_id", F.lit(d).alias("depth"), "relationship_type"))
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
        parts.append(seen.filter("depth > 0").select("root_id", F.lit(name).alias("direction"), "depth", "class_id", "relationship_type"))
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- the cached dashboard


def cached_dashboard(entity: DataFrame, relationship: DataFrame) -> DataFrame:
    """(project_id, analysis_type, data): the numbers of nine analyses as one JSON text a project."""
    parts = {
        "functions": G.functions_of(entity).groupBy("project_id").agg(F.count("*").alias("n")),
        "dead": G.uncalled(entity, relationship).filter("NOT entry_point").groupBy("project_id").agg(F.count("*").alias("n")),
        "smells": G.code_smells(G.function_complexity(entity)).groupBy("project_id").agg(F.count("*").alias("n")),
        "security": G.security_findings(entity).groupBy("project_id").agg(F.count("*").alias("n")),
        "typed": G.type_inference(entity).groupBy("project_id").agg(F.count_if("has_hint").alias("n")),
        "public": G.api_surface(entity, relationship).groupBy("project_id").agg(F.count_if(~F.col("is_private")).alias("n")),
        "documented": G.doc_status(entity).groupBy("project_id").agg(F.count_if("has_comment").alias("n")),
        "scope": G.scope_issues(entity).groupBy("project_id").agg(F.count("*").alias("n")),
        "misnamed": G.naming_compliance(entity).groupBy("project_id").agg(F.count_if(~F.col("compliant")).alias("n")),
    }
    out = None
    for name, part in parts.items():
        part = part.withColumnRenamed("n", name)
        out = part if out is None else out.join(part, "project_id", "left")
    data = F.to_json(F.struct(*[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in parts]))
    return out.select("project_id", F.lit("dashboard").alias("analysis_type"), data.alias("data"))
