"""Queries over the code graph: lookups, call graphs, hierarchies, coupling and quality analyses.

Every operator takes whole tables and gives one DataFrame; a filter on a project or a symbol is an ordinary
``filter`` on the result, which Catalyst pushes down to the scan. ``source`` is read only where it is used and is
never shuffled.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..plans.rounds import cut, stored

# ---------------------------------------------------------------- lookups and counts


def project_stats(project: DataFrame, entity: DataFrame, sourcecode: DataFrame) -> DataFrame:
    """Each project with its numbers of entities and files; both are summed up before the join."""
    e = entity.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("entity_count"))
    s = sourcecode.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("source_count"))
    return project.join(e, "id", "left").join(s, "id", "left").select(F.col("id").alias("project_id"), "name", F.coalesce("entity_count", F.lit(0)).alias("entity_count"), F.coalesce("source_count", F.lit(0)).alias("source_count"))


def entity_list(entity: DataFrame) -> DataFrame:
    return entity.select("id", "project_id", "symbol", "type", "language", "filename", "start_line", "end_line")


def entity_search(entity: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Symbols that contain the text in any case, those that begin with it first; the top ``limit`` with trigram similarity.
    In the containment % and _ stand for any text and any character, in the beginning they stand for themselves."""
    prefix = F.col("symbol").ilike(re.sub(r"([_%\\])", r"\\\1", text) + "%")
    hit = entity.filter(F.col("symbol").ilike(f"%{text}%")).select("id", "symbol", "type", "filename", T.trigram_similarity(F.col("symbol"), F.lit(text)).alias("similarity"), prefix.alias("prefix"))
    return hit.orderBy(F.col("prefix").desc(), F.lower("symbol"), "id").limit(limit)


def entity_search_named(entity: DataFrame, project: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """The same search over all projects, with the name of each find's project."""
    found = entity_search(entity, text, limit).join(entity.select("id", "project_id"), "id")
    return found.join(project.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id", "left")


def functions_per_file(entity: DataFrame) -> DataFrame:
    return entity.filter("type = 'function'").groupBy("project_id", "filename").agg(F.count("*").alias("functions"))


def files_with_counts(sourcecode: DataFrame, entity: DataFrame) -> DataFrame:
    """Every file with its number of functions, zero included."""
    n = entity.filter("type = 'function'").groupBy("project_id", "filename").agg(F.count("*").alias("functions"))
    return sourcecode.select("project_id", "filename").distinct().join(n, ["project_id", "filename"], "left").fillna(0, ["functions"])


def global_stats(project: DataFrame, entity: DataFrame, sourcecode: DataFrame) -> DataFrame:
    a = project.agg(F.count("*").alias("projects"))
    b = entity.agg(F.count("*").alias("entities"), F.countDistinct("language").alias("languages"))
    c = sourcecode.agg(F.count("*").alias("files"))
    return a.join(F.broadcast(b), F.lit(True)).join(F.broadcast(c), F.lit(True))


def definitions_by_name(entity: DataFrame, project: DataFrame) -> DataFrame:
    """Classes and structs by name across projects, with the project's name or Unknown."""
    d = entity.filter(F.col("type").isin("class", "struct")).select("id", "symbol", "type", "project_id", "filename", "start_line")
    return d.join(project.select(F.col("id").alias("project_id"), F.col("name").alias("pname")), "project_id", "left").select("id", "symbol", "type", "filename", "start_line", F.coalesce("pname", F.lit("Unknown")).alias("project_name"))


def first_entity_per_symbol(entity: DataFrame) -> DataFrame:
    """The entity of the lowest id of every symbol and type."""
    return entity.groupBy("symbol", "type").agg(F.min(F.struct("id", "project_id", "filename")).alias("x")).select("symbol", "type", "x.id", "x.project_id", "x.filename")


def class_members(entity: DataFrame) -> DataFrame:
    """Functions strictly inside the line range of a class of the same file."""
    c = entity.filter(F.col("type").isin("class", "struct")).select("project_id", "filename", F.col("id").alias("class_id"), F.col("symbol").alias("class_symbol"), F.col("start_line").alias("cs"), F.col("end_line").alias("ce"))
    m = entity.filter("type = 'function'").select("project_id", "filename", F.col("id").alias("member_id"), F.col("symbol").alias("member_symbol"), F.col("start_line").alias("ms"), F.col("end_line").alias("me"))
    return c.join(m, ["project_id", "filename"]).filter("ms > cs AND me < ce").select("class_id", "class_symbol", "member_id", "member_symbol")


def read_source_slice(sourcecode: DataFrame, first: int, last: int) -> DataFrame:
    """Lines first to last of every file."""
    lines = F.split("source", "\n")
    return sourcecode.filter("source IS NOT NULL").select("id", F.array_join(F.slice(lines, first, last - first + 1), "\n").alias("text"))


# ---------------------------------------------------------------- symbol occurrences


def find_references(refs: DataFrame, entity: DataFrame) -> DataFrame:
    """Occurrences by symbol and file: definitions, writes and reads."""
    return refs.groupBy("project_id", "symbol", "filename").agg(
        F.count("*").alias("total"), F.count_if("is_definition").alias("definitions"), F.count_if(F.col("is_write") & ~F.col("is_definition")).alias("writes"), F.count_if(~F.col("is_write") & ~F.col("is_definition")).alias("reads")
    )


def go_to_definition(refs: DataFrame, entity: DataFrame) -> DataFrame:
    """Of every project's symbol the first defining occurrence by file and line, else the first entity."""
    a = refs.filter("is_definition").select("project_id", "symbol", F.lit(0).alias("rank"), "filename", "line")
    b = entity.select("project_id", "symbol", F.lit(1).alias("rank"), "filename", F.col("start_line").alias("line"))
    best = a.unionByName(b).groupBy("project_id", "symbol").agg(F.min(F.struct("rank", "filename", "line")).alias("x"))
    return best.select("project_id", "symbol", F.when(F.col("x.rank") == 0, "occurrence").otherwise("entity").alias("found_in"), "x.filename", "x.line")


def list_definitions(refs: DataFrame) -> DataFrame:
    return refs.filter("is_definition").groupBy("project_id", "symbol_type", "filename").agg(F.count("*").alias("definitions"))


def reference_summary(refs: DataFrame, limit: int = 100) -> DataFrame:
    """The most frequent symbols: occurrences, definitions, writes."""
    g = refs.groupBy("symbol", "symbol_type").agg(F.count("*").alias("reference_count"), F.count_if("is_definition").alias("definition_count"), F.count_if("is_write").alias("write_count"))
    return g.orderBy(F.col("reference_count").desc(), "symbol", "symbol_type").limit(limit)


def symbols_at(refs: DataFrame, entity: DataFrame) -> DataFrame:
    """Occurrences with the column range they cover (a null column is column zero) and their definition, where known."""
    e = entity.select(F.col("id").alias("definition_entity_id"), F.col("symbol").alias("definition_symbol"), F.col("start_line").alias("definition_line"))
    return refs.select("id", "filename", "line", F.coalesce("column_start", F.lit(0)).alias("column_from"), "column_end", "symbol", "definition_entity_id").join(e, "definition_entity_id", "left").drop("definition_entity_id")


def enclosing_functions(places: DataFrame, entity: DataFrame) -> DataFrame:
    """The places (project_id, filename, line) with the smallest function around them, of several the one of the least id."""
    f = functions_of(entity).select("project_id", "filename", "start_line", "end_line", F.col("id").alias("function_id"), F.col("symbol").alias("function"))
    around = places.select("project_id", "filename", "line").distinct().join(f, ["project_id", "filename"]).filter("line BETWEEN start_line AND end_line")
    x = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "function_id", "function")).alias("x")
    return around.groupBy("project_id", "filename", "line").agg(x).select("project_id", "filename", "line", "x.function_id", "x.function")


def symbols_at_location(refs: DataFrame, entity: DataFrame, places: DataFrame) -> DataFrame:
    """The occurrences at places (project_id, filename, line, column): those whose columns, both ends included, hold the
    place's, or all of the line where the place names no column; with what is known of their definition."""
    r = refs.select("id", "project_id", "filename", "line", "symbol", "symbol_type", F.coalesce("column_start", F.lit(0)).alias("column_from"), "column_end", "is_definition", "is_write", "definition_entity_id")
    e = entity.select(F.col("id").alias("definition_entity_id"), F.col("filename").alias("definition_filename"), F.col("start_line").alias("definition_line"), "parameters", "return_type", "comment")
    at = r.join(places.select("project_id", "filename", "line", F.col("column").alias("column_at")).distinct(), ["project_id", "filename", "line"])
    return at.filter("column_at IS NULL OR column_at BETWEEN column_from AND column_end").join(e, "definition_entity_id", "left").drop("definition_entity_id")


# ---------------------------------------------------------------- calls


def _named(entity: DataFrame, prefix: str) -> DataFrame:
    return entity.select(F.col("id").alias(prefix), F.col("symbol").alias(f"{prefix}_symbol"), F.col("filename").alias(f"{prefix}_file"), F.col("project_id").alias(f"{prefix}_project"))


def call_edges(relationship: DataFrame, entity: DataFrame) -> DataFrame:
    """Distinct (caller, callee, line) between known entities."""
    e = relationship.filter("caller IS NOT NULL AND callee IS NOT NULL AND line IS NOT NULL").select("caller", "callee", "line").distinct()
    ids = entity.select("id")
    return e.join(ids.withColumnRenamed("id", "caller"), "caller", "left_semi").join(ids.withColumnRenamed("id", "callee"), "callee", "left_semi").select("caller", "callee", "line")


def function_calls(relationship: DataFrame, entity: DataFrame) -> DataFrame:
    """Every call with both ends' symbols: filtered by callee_symbol it gives callers, by caller_symbol callees."""
    r = relationship.filter("caller IS NOT NULL AND callee IS NOT NULL").select(F.col("id").alias("call_id"), "caller", "callee", "line")
    return r.join(_named(entity, "caller"), "caller").join(_named(entity, "callee"), "callee").select("call_id", "caller", "caller_symbol", "callee", "callee_symbol", "line")


def busiest(edges: DataFrame, up: bool = False) -> DataFrame:
    """One row: the node with the most distinct callees (``up``: callers), the smallest of several."""
    node, other = ("callee", "caller") if up else ("caller", "callee")
    d = edges.groupBy(node).agg(F.countDistinct(other).alias("n"))
    return d.orderBy(F.col("n").desc(), node).limit(1).select(F.col(node).alias("node"))


def reach(edges: DataFrame, roots: DataFrame, depth: int, up: bool = False) -> DataFrame:
    """(node, dist) of all nodes within ``depth`` steps of the roots; each node is expanded once."""
    a, b = ("callee", "caller") if up else ("caller", "callee")
    seen = cut(roots.select("node", F.lit(0).alias("dist")))
    front = seen
    for d in range(1, depth + 1):
        step = edges.join(front.select(F.col("node").alias(a)), a, "left_semi").select(F.col(b).alias("node")).distinct()
        front = cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("dist")))
        if front.limit(1).count() == 0:
            break
        seen = seen.unionByName(front)
    return seen


def reach_edges(edges: DataFrame, roots: DataFrame, depth: int, up: bool = False) -> DataFrame:
    """(caller, callee, line, depth) of the edges whose near end lies within depth - 1 steps."""
    seen = reach(edges, roots, depth, up)
    near = "callee" if up else "caller"
    return edges.join(seen.filter(F.col("dist") < depth).select(F.col("node").alias(near), (F.col("dist") + 1).alias("depth")), near).select("caller", "callee", "line", "depth")


def call_graph_edges(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Edges down- and upstream of the roots with the least depth each way."""
    down = reach_edges(edges, roots, depth).withColumnRenamed("depth", "callee_depth")
    up = reach_edges(edges, roots, depth, up=True).withColumnRenamed("depth", "caller_depth")
    return down.join(up, ["caller", "callee", "line"], "full_outer")


def call_graph_nodes(edges: DataFrame, roots: DataFrame, depth: int, entity: DataFrame) -> DataFrame:
    both = reach(edges, roots, depth).select("node").union(reach(edges, roots, depth, up=True).select("node")).distinct()
    named = both.join(entity.select(F.col("id").alias("node"), "symbol", "type", "filename"), "node")
    return named.join(F.broadcast(roots.select("node", F.lit(True).alias("r"))), "node", "left").select("node", "symbol", "type", "filename", F.coalesce("r", F.lit(False)).alias("is_root"))


def call_heatmap(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Calls of each node over the edges downstream of the roots, the root one more, and their share of the most called."""
    e = reach_edges(edges, roots, depth).select(F.col("callee").alias("node"))
    n = e.unionByName(roots.select("node")).groupBy("node").agg(F.count("*").alias("caller_count"))
    most = n.agg(F.max("caller_count").alias("most"))
    return n.join(F.broadcast(most), F.lit(True)).select("node", "caller_count", (F.col("caller_count") / F.col("most")).alias("heat"))


def tree_edges(edges: DataFrame, roots: DataFrame, depth: int, up: bool = False) -> DataFrame:
    """(node, next, depth, path) of every step of every path from the roots, distinct edges once a path; a node that
    the path already holds ends it. All paths are what is asked for, so the rows may grow exponentially with the depth;
    ``reach_edges`` gives each edge once."""
    a, b = ("callee", "caller") if up else ("caller", "callee")
    pairs = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    front = roots.select("node", F.array("node").alias("path"))
    out = []
    for d in range(1, depth + 1):
        step = cut(pairs.join(front, "node").select("node", "next", F.lit(d).alias("depth"), F.concat("path", F.array("next")).alias("path")))
        out.append(step)
        front = step.filter(~F.array_contains(F.slice("path", 1, d), F.col("next"))).select(F.col("next").alias("node"), "path")
    return reduce(DataFrame.unionByName, out).select("node", "next", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


# ---------------------------------------------------------------- files as a graph


def file_dependencies(relationship: DataFrame, entity: DataFrame) -> DataFrame:
    """Calls between different files of a project, with up to five examples in order; examples are counted up to their
    fifth before they are gathered."""
    r = relationship.filter("caller IS NOT NULL AND callee IS NOT NULL").select("caller", "callee").join(_named(entity, "caller"), "caller").join(_named(entity, "callee"), "callee")
    r = r.filter("caller_project = callee_project AND caller_file <> callee_file")
    key = ["project_id", "source_file", "target_file"]
    pairs = r.groupBy(F.col("caller_project").alias("project_id"), F.col("caller_file").alias("source_file"), F.col("callee_file").alias("target_file"), F.concat_ws(" -> ", "caller_symbol", "callee_symbol").alias("example")).agg(F.count("*").alias("n"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("example")))
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.col("example"))))
    return ranked.groupBy(*key).agg(F.sum("n").alias("calls"), F.array_join(first, "; ").alias("examples"))


def file_coupling(dependencies: DataFrame) -> DataFrame:
    """Efferent and afferent files of every file, and its instability to two digits."""
    e = dependencies.groupBy("project_id", F.col("source_file").alias("filename")).agg(F.count("*").alias("efferent"))
    a = dependencies.groupBy("project_id", F.col("target_file").alias("filename")).agg(F.count("*").alias("afferent"))
    m = e.join(a, ["project_id", "filename"], "full_outer").fillna(0, ["efferent", "afferent"])
    return m.withColumn("instability", T.half_up(F.col("efferent") / (F.col("efferent") + F.col("afferent")), 2))


def circular_dependencies(dependencies: DataFrame) -> DataFrame:
    """Pairs of files that depend on each other."""
    x = dependencies.select("project_id", F.col("source_file").alias("file_a"), F.col("target_file").alias("file_b"))
    y = dependencies.select("project_id", F.col("target_file").alias("file_a"), F.col("source_file").alias("file_b"))
    return x.join(y, ["project_id", "file_a", "file_b"], "left_semi").filter("file_a < file_b")


# ---------------------------------------------------------------- classes


def implementations(inheritance: DataFrame, entity: DataFrame) -> DataFrame:
    """Children of every parent symbol by relationship type."""
    i = inheritance.select("child_entity_id", "parent_symbol", F.lower(F.trim("relationship_type")).alias("relationship_type")).distinct()
    return i.join(entity.select(F.col("id").alias("child_entity_id"), F.col("symbol").alias("child_symbol")), "child_entity_id")


def hierarchy_counts(inheritance: DataFrame) -> DataFrame:
    return inheritance.groupBy(F.lower(F.trim("relationship_type")).alias("relationship_type")).agg(F.count("*").alias("n"), F.countDistinct("child_entity_id").alias("children"))


def roots_and_leaves(edges: DataFrame) -> DataFrame:
    """Classes of the hierarchy that have no parent (root), no child (leaf), or either. edges: child, parent."""
    c, p = edges.select(F.col("child").alias("id")).distinct(), edges.select(F.col("parent").alias("id")).distinct()
    roots = p.join(c, "id", "left_anti").select("id", F.lit("root").alias("role"))
    leaves = c.join(p, "id", "left_anti").select("id", F.lit("leaf").alias("role"))
    return roots.unionByName(leaves)


# ---------------------------------------------------------------- analyses of functions


def functions_of(entity: DataFrame) -> DataFrame:
    return entity.filter("type = 'function'")


def uncalled(entity: DataFrame, relationship: DataFrame) -> DataFrame:
    """Functions without a caller in their own project, and whether their name is that of an entry point."""
    f = functions_of(entity).select("id", "project_id", "symbol", "filename", (F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    called = relationship.filter("caller IS NOT NULL AND callee IS NOT NULL").select("caller", F.col("callee").alias("id")).join(entity.select(F.col("id").alias("caller"), "project_id"), "caller").select("id", "project_id").distinct()
    dead = f.join(called, ["id", "project_id"], "left_anti")
    return dead.withColumn("entry_point", F.col("symbol").rlike(R.ENTRY_POINTS) | F.col("symbol").rlike(R.ENTRY_POINTS_CASED))


def dead_code(entity: DataFrame, relationship: DataFrame) -> DataFrame:
    return uncalled(entity, relationship).select("id", "project_id", "symbol", "filename", "lines", "entry_point")


def dead_code_summary(entity: DataFrame, relationship: DataFrame) -> DataFrame:
    u = uncalled(entity, relationship).groupBy("project_id").agg(F.count_if(~F.col("entry_point")).alias("dead_functions"), F.count_if("entry_point").alias("entry_points"), F.sum(F.when(~F.col("entry_point"), F.col("lines")).otherwise(0)).alias("dead_lines"))
    t = functions_of(entity).groupBy("project_id").agg(F.count("*").alias("functions"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("total_lines"))
    return t.join(u, "project_id", "left").fillna(0).withColumn("dead_pct", T.half_up(F.when(F.col("total_lines") > 0, F.col("dead_lines") / F.col("total_lines") * 100).otherwise(0.0), 1))


def function_complexity(entity: DataFrame) -> DataFrame:
    f = functions_of(entity)
    m = f.select("id", "project_id", "symbol", "filename", T.cyclomatic(F.col("source"), F.col("language")).alias("cyclomatic"), T.nesting(F.col("source")).alias("nesting"), T.lines_of_code(F.col("source")).alias("loc"), T.parameter_count(F.col("parameters")).alias("params"), (F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    return m.withColumn("rating", T.rating(F.col("cyclomatic")))


def file_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("project_id", "filename").agg(F.count("*").alias("functions"), F.sum("cyclomatic").alias("total_cyclomatic"), F.max("cyclomatic").alias("max_cyclomatic"), F.sum("loc").alias("total_loc"), F.max("nesting").alias("max_nesting"))


def code_metrics(metrics: DataFrame) -> DataFrame:
    """Each project's averages, the distribution of ratings and the maintainability index."""
    g = metrics.groupBy("project_id").agg(
        F.count("*").alias("functions"), T.half_up(F.avg("cyclomatic"), 1).alias("avg_cyclomatic"), F.max("cyclomatic").alias("max_cyclomatic"), T.half_up(F.avg("loc"), 1).alias("avg_loc"),
        *[F.count_if(F.col("rating") == r).alias(f"{r}_count") for r in ("low", "moderate", "high", "very_high")],
    )
    loc, cc = F.when(F.col("avg_loc") == 0, 1.0).otherwise(F.col("avg_loc")), F.when(F.col("avg_cyclomatic") == 0, 1.0).otherwise(F.col("avg_cyclomatic"))
    mi = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(171.0) - F.lit(5.2) * F.log(loc * cc) - F.lit(0.23) * cc - F.lit(16.2) * F.log(loc)))
    return g.withColumn("maintainability", F.floor(mi + 0.5).cast("long")).withColumn("maintainability_rating", F.when(mi >= 80, "High").when(mi >= 60, "Medium").when(mi >= 40, "Low").otherwise("Very Low"))


def code_smells(metrics: DataFrame) -> DataFrame:
    """One row for each smell of each function."""
    kinds = [
        ("long_method", F.col("lines") > 50, F.col("lines"), F.col("lines") > 200), ("god_function", F.col("lines") > 200, F.col("lines"), F.lit(True)),
        ("long_parameter_list", F.col("params") > 5, F.col("params"), F.col("params") > 8), ("high_complexity", F.col("cyclomatic") > 15, F.col("cyclomatic"), F.col("cyclomatic") > 25),
        ("deep_nesting", F.col("nesting") > 4, F.col("nesting"), F.col("nesting") > 6),
    ]
    made = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("smell"), v.cast("long").alias("value"), F.when(h, "high").otherwise("medium").alias("severity"))) for k, c, v, h in kinds]))
    return metrics.select("id", "project_id", "symbol", F.explode(made).alias("x")).select("id", "project_id", "symbol", "x.smell", "x.value", "x.severity")


def name_suspects(entity: DataFrame) -> DataFrame:
    """Names, trailing digits aside, that more than two functions of a project have."""
    g = functions_of(entity).groupBy("project_id", F.regexp_replace("symbol", r"[0-9]+\z", "").alias("base_name")).agg(F.count("*").alias("n"))
    return g.filter("n > 2 AND length(base_name) > 3").withColumn("severity", F.when(F.col("n") > 5, "medium").otherwise("low"))


def security_findings(entity: DataFrame) -> DataFrame:
    """One row for each rule family that a function hits."""
    hits = [F.when(reduce(Column.__or__, [F.col("source").rlike(p) for p in pats]), F.struct(F.lit(k).alias("rule"), F.lit(sev).alias("severity"))) for k, (sev, pats) in R.SECURITY.items()]
    return functions_of(entity).filter("source IS NOT NULL").select("id", "project_id", "filename", F.explode(F.array_compact(F.array(*hits))).alias("x")).select("id", "project_id", "filename", "x.rule", "x.severity")


def type_inference(entity: DataFrame) -> DataFrame:
    """Functions of dynamic languages: whether they state a type, else what their first return shows."""
    f = functions_of(entity).filter(F.col("language").isin("javascript", "python", "ruby", "php"))
    hint = ((F.col("language") == "python") & F.coalesce(F.col("source").rlike(r"->\s*\w+"), F.lit(False))) | ((F.col("language") == "javascript") & F.coalesce((F.col("return_type") != "") & (F.col("return_type") != "function"), F.lit(False)))
    expr = F.regexp_extract("source", r"return\s+([^;}\n]+)", 1)
    kind = F.when(F.col("source").isNull() | (expr == ""), "unknown")
    for name, p in R.RETURN_TYPES:
        kind = kind.when(expr.rlike(p), name)
    return f.select("id", "project_id", "symbol", "language", hint.alias("has_hint"), F.when(hint, F.lit(None)).otherwise(kind.otherwise("unknown")).alias("inferred"))


def api_surface(entity: DataFrame, relationship: DataFrame) -> DataFrame:
    """Functions with their visibility, callers, and whether they are entry points or undocumented."""
    n = relationship.filter("callee IS NOT NULL").groupBy(F.col("callee").alias("id")).agg(F.count("*").alias("callers"))
    f = functions_of(entity)
    private = reduce(Column.__or__, [F.col("symbol").rlike(p) | F.coalesce(F.col("source").rlike(p), F.lit(False)) for p in R.PRIVATE])
    f = f.select("id", "project_id", "symbol", private.alias("is_private"), (F.coalesce(F.length("comment"), F.lit(0)) > 0).alias("documented"), F.when(F.coalesce(F.col("parameters"), F.lit("")) == "", 0).otherwise(F.size(F.split("parameters", ","))).alias("params"))
    return f.join(n, "id", "left").fillna(0, ["callers"]).withColumn("entry_point", ~F.col("is_private") & ((F.col("callers") >= 3) | F.col("symbol").rlike(R.API_ENTRIES)))


def doc_status(entity: DataFrame) -> DataFrame:
    c = F.coalesce("comment", F.lit(""))
    has = F.length(F.trim(c)) > 10
    params = F.size(F.filter(F.split(F.coalesce("parameters", F.lit("")), ","), lambda x: F.trim(x) != ""))
    status = (
        F.when(~has, "undocumented").when((params > 0) & ~c.rlike("@param|:param|Args:|Parameters:"), "partial_params")
        .when((F.coalesce("return_type", F.lit("")) != "") & (F.col("return_type") != "void") & ~c.rlike("@returns?|:returns?:|Returns:"), "partial_return").otherwise("documented")
    )
    return functions_of(entity).select("id", "project_id", "symbol", "filename", has.alias("has_comment"), status.alias("status"))


def doc_coverage(status: DataFrame) -> DataFrame:
    g = status.groupBy("project_id", "filename").agg(F.count("*").alias("functions"), F.count_if("has_comment").alias("commented"))
    return g.withColumn("coverage", F.floor(F.col("commented") / F.col("functions") * 100 + 0.5).cast("long"))


def scope_issues(entity: DataFrame) -> DataFrame:
    """Uses of globals, names declared again and variables caught in closures, with their numbers."""
    f = functions_of(entity).filter("source IS NOT NULL")
    js = F.col("language").isin("javascript", "typescript")
    glob = F.lit(False)
    for lang, p in R.GLOBALS.items():
        glob = glob | ((F.col("language") == lang) & F.col("source").rlike(p))
    names = F.concat(F.regexp_extract_all("source", F.lit(r"\b(?:let|const)\s+(\w+)"), 1), F.regexp_extract_all("source", F.lit(r"\bvar\s+(\w+)"), 1))
    again = F.when(js, F.size(names) - F.size(F.array_distinct(names))).otherwise(0)
    closure = js & F.col("source").rlike(r"\blet\s+\w+") & F.col("source").rlike(r"\.(forEach|map|filter|reduce)\s*\(")
    made = F.array_compact(F.array(F.when(glob, F.struct(F.lit("global").alias("issue"), F.lit(1).alias("n"))), F.when(again > 0, F.struct(F.lit("shadowing").alias("issue"), again.alias("n"))), F.when(closure, F.struct(F.lit("closure").alias("issue"), F.lit(1).alias("n")))))
    return f.select("id", "project_id", F.explode(made).alias("x")).select("id", "project_id", "x.issue", "x.n")


def naming_compliance(entity: DataFrame) -> DataFrame:
    """Symbols with the styles they have and whether one is expected of their language and kind."""
    styles = F.array_compact(F.array(*[F.when(F.col("symbol").rlike(p), F.lit(k)) for k, p in R.STYLES.items()]))
    want = F.lit(None)
    for lang, var in R.VARIABLE_STYLES.items():
        for kind in ("function", "class", "struct"):
            exp = R.EXPECTED_STYLES.get((lang, kind), var)
            want = F.when((F.col("language") == lang) & (F.col("type") == kind), F.array(*[F.lit(x) for x in exp])).otherwise(want)
    e = entity.filter(_own_name()).select("id", "project_id", "symbol", "type", "language", styles.alias("styles"), want.alias("want"))
    return e.select("id", "project_id", "symbol", F.when(F.size("styles") == 0, "unknown").otherwise(F.array_join("styles", ",")).alias("detected"), F.coalesce(F.arrays_overlap("styles", "want"), F.lit(True)).alias("compliant"))


def error_handling(entity: DataFrame) -> DataFrame:
    """Handled, empty and finally blocks of functions of languages with known forms."""
    f = functions_of(entity).filter(F.col("source").isNotNull() & F.col("language").isin(*R.ERROR_HANDLING))

    def pick(i: int) -> Column:
        out = F.lit(0)
        for lang, pats in R.ERROR_HANDLING.items():
            out = F.when(F.col("language") == lang, T.count(F.col("source"), pats[i])).otherwise(out)
        return out

    m = f.select("id", "project_id", pick(0).alias("handled"), pick(1).alias("empty"), pick(2).alias("finally_blocks"))
    return m.withColumn("coverage", F.when(F.col("handled") == 0, "none").when(F.col("empty") > F.col("handled") / 2, "poor").when(F.col("finally_blocks") > 0, "good").otherwise("moderate"))


def concurrency_findings(entity: DataFrame) -> DataFrame:
    """One row for each form of concurrency that a function uses, by its language's rules or else JavaScript's."""
    hits = []
    for lang, rows in R.CONCURRENCY.items():
        own = F.col("language") == lang if lang != "javascript" else ~F.col("language").isin(*[x for x in R.CONCURRENCY if x != "javascript"])
        hits += [F.when(own & F.col("source").rlike(p), F.struct(F.lit(c).alias("category"), F.lit(k).alias("kind"))) for c, k, p in rows]
    f = functions_of(entity).filter("source IS NOT NULL AND language IS NOT NULL")
    return f.select("id", "project_id", F.explode(F.array_compact(F.array(*hits))).alias("x")).select("id", "project_id", "x.category", "x.kind")


def concurrency_warnings(findings: DataFrame) -> DataFrame:
    """Functions with asynchronous or threaded code and no synchronisation, and those that take more kinds of locks than they give back."""
    kind = lambda *names: F.count_if(F.col("kind").isin(*names))
    g = findings.groupBy("id", "project_id").agg(
        F.count_if(F.col("category").isin("async", "thread")).alias("a"), F.count_if(F.col("category") == "sync").alias("s"),
        F.count_if((F.col("category") == "sync") & F.col("kind").isin(*R.LOCK_TAKEN)).alias("taken"), F.count_if((F.col("category") == "sync") & F.col("kind").isin(*R.LOCK_GIVEN)).alias("given"),
    )
    made = F.array_compact(F.array(F.when((F.col("a") > 0) & (F.col("s") == 0), "shared_state_no_lock"), F.when(F.col("taken") > F.col("given"), "lock_not_released")))
    return g.select("id", "project_id", F.explode(made).alias("warning"))


def resource_findings(entity: DataFrame) -> DataFrame:
    """Resources that functions acquire, and whether they may leak: unless the function also releases, or uses a form of its
    language that releases by itself."""
    src, hits = F.col("source"), []
    for lang, rows in R.RESOURCES.items():
        formed = src.rlike(R.RELEASED_BY_FORM[lang]) if lang in R.RELEASED_BY_FORM else F.lit(False)
        hits += [F.when((F.col("language") == lang) & src.rlike(a), F.struct(F.lit(k).alias("kind"), F.lit(n).alias("resource"), (~src.rlike(r) & ~formed).alias("leak"))) for k, n, a, r in rows]
    f = functions_of(entity).filter(src.isNotNull() & F.col("language").isin(*R.RESOURCES))
    return f.select("id", "project_id", F.explode(F.array_compact(F.array(*hits))).alias("x")).select("id", "project_id", "x.kind", "x.resource", "x.leak")


def resource_holders(entity: DataFrame) -> DataFrame:
    """Resources that functions release, and the safe holders they use."""
    src, hits = F.col("source"), []
    hit = lambda lang, p, finding, k, n: F.when((F.col("language") == lang) & src.rlike(p), F.struct(F.lit(finding).alias("finding"), F.lit(k).alias("kind"), F.lit(n).alias("resource")))
    for lang, rows in R.RESOURCES.items():
        hits += [hit(lang, r, "release", k, n) for k, n, _, r in rows]
    for lang, rows in R.SAFE_RESOURCES.items():
        hits += [hit(lang, p, "safe", k, n) for k, n, p in rows]
    f = functions_of(entity).filter(src.isNotNull() & F.col("language").isin(*R.RESOURCES))
    return f.select("id", "project_id", F.explode(F.array_compact(F.array(*hits))).alias("x")).select("id", "project_id", "x.finding", "x.kind", "x.resource")


def resource_warnings(entity: DataFrame) -> DataFrame:
    """Functions that handle memory in a way their language warns of."""
    hits = [F.when((F.col("language") == lang) & F.col("source").rlike(shows) & ~F.col("source").rlike(averts), F.struct(F.lit(w).alias("warning"), F.lit(sev).alias("severity"))) for lang, (w, sev, shows, averts) in R.RESOURCE_WARNINGS.items()]
    return functions_of(entity).filter("source IS NOT NULL").select("id", "project_id", F.explode(F.array_compact(F.array(*hits))).alias("x")).select("id", "project_id", "x.warning", "x.severity")


def _by_language(table: dict[str, str], default: str, make) -> Column:
    out = make(table[default])
    for lang, p in table.items():
        out = F.when(F.col("language") == lang, make(p)).otherwise(out)
    return out


def design_patterns(entity: DataFrame) -> DataFrame:
    """The design patterns that entities of any type show in the forms of their language."""
    hits = []
    for category, names in R.PATTERN_KINDS.items():
        for name in names:
            test = F.lit(False)
            for lang in R.PATTERN_LANGUAGES:
                own = ~F.col("language").isin(*[x for x in R.PATTERN_LANGUAGES if x != lang]) if lang == "javascript" else F.col("language") == lang
                if forms := R.pattern_forms(name, lang):
                    test = F.when(own, F.col("source").rlike("|".join(f"(?:{x})" for x in forms))).otherwise(test)
            hits.append(F.when(test, F.struct(F.lit(name).alias("pattern"), F.lit(category).alias("category"))))
    f = entity.filter("source IS NOT NULL AND language IS NOT NULL").withColumn("language", F.lower("language"))
    return f.select("id", "project_id", F.explode(F.array_compact(F.array(*hits))).alias("x")).select("id", "project_id", "x.pattern", "x.category")


def coverage_gaps(entity: DataFrame) -> DataFrame:
    """Files of no tests whose base name stands in no test file's path of the project. The parts of test paths are cut into
    all their substrings, which turns the containment into an equality."""
    is_test = _by_language(R.TEST_FILES, "javascript", lambda p: F.col("filename").rlike(p))
    f = functions_of(entity).filter("filename IS NOT NULL").select("project_id", "filename", is_test.alias("is_test")).distinct()
    base = F.element_at(F.split(F.regexp_replace("filename", r"\.\w+\z", ""), "/"), -1)
    parts = f.filter("is_test").select("project_id", F.explode(F.split("filename", "/")).alias("part")).filter("part <> ''").distinct()
    starts = parts.select("project_id", "part", F.explode(F.sequence(F.lit(1), F.length("part"))).alias("i"))
    pieces = starts.select("project_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("part") - F.col("i") + 1), lambda n: F.col("part").substr(F.col("i"), n))).alias("base")).distinct()
    return f.filter("NOT is_test").select("project_id", "filename", base.alias("base")).join(pieces, ["project_id", "base"], "left_anti").select("project_id", "filename")


def _counted(patterns: list[str]) -> Column:
    return reduce(Column.__add__, [T.count(F.coalesce("source", F.lit("")), p) for p in patterns])


def test_quality(entity: DataFrame) -> DataFrame:
    """Each project's tests: functions of test files that look like tests, their assertions and mocks, tests without any
    assertion, and names that are too short, numbered, bare, or not of their language's form."""
    by = lambda table, make: _by_language(table, "javascript", make)
    f = functions_of(entity).filter("filename IS NOT NULL").withColumn("source", F.coalesce("source", F.lit("")))
    f = f.filter(by(R.TEST_FILES, lambda p: F.col("filename").rlike(p))).filter(by(R.TEST_FUNCTIONS, lambda ps: reduce(Column.__or__, [F.col("source").rlike(p) for p in ps])))
    named = F.lit(True)
    for lang, p in R.TEST_NAMES.items():
        named = F.when(F.col("language") == lang, F.col("symbol").rlike(p)).otherwise(named)
    f = f.select("project_id", "symbol", by(R.ASSERTIONS, _counted).alias("asserts"), by(R.MOCKS, _counted).alias("mocks"), named.alias("named"))
    g = f.groupBy("project_id").agg(
        F.count("*").alias("tests"), F.sum("asserts").alias("assertions"), F.sum("mocks").alias("mocks"), F.count_if(F.col("asserts") == 0).alias("without_assertion"), F.count_if(F.length("symbol") < 10).alias("short_names"),
        F.count_if(F.col("symbol").rlike(r"^test\d+\z")).alias("numbered_names"), F.count_if(F.col("symbol") == "test").alias("bare_names"), F.count_if(~F.col("named")).alias("odd_names"),
    )
    return g.withColumn("assertions_per_test", T.half_up(F.col("assertions") / F.col("tests"), 2))


def test_coverage(entity: DataFrame) -> DataFrame:
    """Each project's files of tests and others, their functions and the assertions in tests."""
    is_test = _by_language(R.TEST_FILES, "javascript", lambda p: F.col("filename").rlike(p))
    asserts = _by_language(R.ASSERTIONS, "javascript", _counted)
    f = functions_of(entity).filter("filename IS NOT NULL").select("project_id", "filename", is_test.alias("is_test"), asserts.alias("asserts"))
    return f.groupBy("project_id").agg(
        F.countDistinct(F.when(F.col("is_test"), F.col("filename"))).alias("test_files"), F.countDistinct(F.when(~F.col("is_test"), F.col("filename"))).alias("other_files"),
        F.count_if("is_test").alias("test_functions"), F.sum(F.when(F.col("is_test"), F.col("asserts")).otherwise(0)).alias("assertions"),
    )


def readability(entity: DataFrame) -> DataFrame:
    """The measures behind the readability score of every function: identifiers, comments, lines and operators."""
    f = functions_of(entity).filter("source IS NOT NULL AND source <> ''")
    lines = F.split("source", "\n")
    words = F.filter(F.regexp_extract_all("source", F.lit(r"(?<![A-Za-z0-9_])([a-zA-Z_][a-zA-Z0-9_]*)"), 1), lambda w: (F.length(w) > 1) | w.isin("i", "j", "k", "n", "x", "y", "z"))
    good = F.size(F.filter(words, lambda w: F.length(w).between(3, 25)))
    ident = F.when(F.size(words) == 0, 100).otherwise(F.floor(good / F.size(words) * 100 + 0.5)).cast("long")
    longest = F.array_max(F.transform(lines, lambda x: F.length(x)))
    most = F.array_max(F.transform(lines, lambda x: T.count(x, r"(?i)&&|\|\||and\s|or\s|\bnot\s")))
    n = F.col("end_line") - F.col("start_line") + 1

    def score(v: Column, a: int, b: int, c: int, d: int) -> Column:
        return F.when(v <= a, 100.0).when(v <= b, 85.0).when(v <= c, 70.0).when(v <= d, 50.0).otherwise(F.greatest(F.lit(0.0), F.lit(50.0) - (v - d) * 2.0))

    return f.select("id", "project_id", ident.alias("identifier_score"), longest.cast("long").alias("longest_line"), most.cast("long").alias("boolean_operators"), score(n, 20, 50, 100, 200).alias("length_score"), score(most, 2, 3, 5, 7).alias("boolean_score"))


def readability_score(entity: DataFrame) -> DataFrame:
    """The weighted readability score of every function with source, its parts and the rating; combined_score also weighs the length."""
    base = readability(entity).select("id", "identifier_score", "boolean_score", "length_score")
    f = functions_of(entity).filter("source IS NOT NULL AND source <> ''")
    lines = F.split("source", "\n")
    full = F.filter(lines, lambda x: F.trim(x) != "")
    mark = F.when(F.col("language").isin("python", "ruby"), F.lit(r"^\s*#")).when(F.col("language").isin("javascript", "typescript", "java", "go", "rust", "c", "cpp"), F.lit(r"^\s*//")).otherwise(F.lit(r"^\s*(//|#)"))
    ratio = F.when(F.size(full) == 0, 0.0).otherwise(F.size(F.filter(full, lambda x: F.regexp_like(x, mark))) / F.size(full))
    comments = F.when(ratio >= 0.2, 100.0).when(ratio >= 0.1, 85.0).when(ratio >= 0.05, 70.0).when(ratio >= 0.02, 50.0).otherwise(F.greatest(F.lit(0.0), F.lit(50.0) - (F.lit(0.02) - ratio) * 10))

    def step(acc: Column, x: Column) -> Column:
        opened = acc % 100000 + T.count(x, r"[{\[(]")
        return F.greatest(F.floor(acc / 100000), opened) * 100000 + F.greatest(opened - T.count(x, r"[}\])]"), F.lit(0))

    deepest = F.floor(F.aggregate(lines, F.lit(0).cast("long"), step) / 100000)

    def score(v: Column, a: int, b: int, c: int, d: int) -> Column:
        return F.when(v <= a, 100.0).when(v <= b, 85.0).when(v <= c, 70.0).when(v <= d, 50.0).otherwise(F.greatest(F.lit(0.0), F.lit(50.0) - (v - d) * 2.0))

    lengths = F.filter(F.transform(lines, lambda x: F.length(x)), lambda n: n > 0)
    over = F.size(F.filter(lengths, lambda n: n > 120)) / F.size(lengths) * 100
    longest = F.when(F.size(lengths) == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.floor(score(F.array_max(lengths), 80, 100, 120, 150) - F.least(F.lit(30.0), over) + 0.5)))
    plain = F.filter(lines, lambda x: ~F.regexp_like(x, F.lit(r"^\s*(//|#|/\*)")) & ~F.regexp_like(x, F.lit(r"(?i)\b(const|final|static|#define)\b")) & ~F.regexp_like(x, F.lit(r"\[\s*\d+\s*\]")))
    found = F.flatten(F.transform(plain, lambda x: F.regexp_extract_all(x, F.lit(r"(?<![\w.])(\d+\.?\d*)\b(?![\w.])"), 1)))
    magic = F.size(F.filter(found, lambda n: ~n.cast("double").isin(*R.PLAIN_NUMBERS)))
    m = f.select("id", "project_id", F.floor(comments + 0.5).alias("comment_score"), F.floor(score(deepest, 2, 3, 4, 6) + 0.5).alias("nesting_score"), longest.alias("line_score"), F.floor(score(magic, 0, 2, 5, 10) + 0.5).alias("number_score"))
    w = R.READABILITY_WEIGHTS
    total = F.col("identifier_score") * w["identifiers"] + F.col("comment_score") * w["comments"] + F.col("nesting_score") * w["nesting"] + F.col("line_score") * w["lines"] + F.col("number_score") * w["numbers"] + F.col("boolean_score") * w["booleans"]
    out = m.join(base, "id").withColumn("score", F.floor(total / (1 - R.READABILITY_LENGTH) + 0.5).cast("long"))
    out = out.withColumn("combined_score", F.floor(F.col("score") * (1 - R.READABILITY_LENGTH) + F.floor(F.col("length_score") + 0.5) * R.READABILITY_LENGTH + 0.5).cast("long"))
    return out.withColumn("rating", F.when(F.col("score") >= 85, "excellent").when(F.col("score") >= 70, "good").when(F.col("score") >= 55, "acceptable").when(F.col("score") >= 40, "poor").otherwise("very_poor"))


def _own_name() -> Column:
    """No name that a language or a generator makes."""
    return ~(F.col("symbol").startswith("__") & F.col("symbol").endswith("__")) & ~F.col("symbol").startswith("$")


def naming_issues(entity: DataFrame) -> DataFrame:
    """One row for each issue that the form of an entity's name shows."""
    hits = [F.when(F.col("symbol").rlike(p), F.lit(k)) for k, p in R.NAME_ISSUES.items()]
    return entity.filter(_own_name()).select("id", "project_id", "symbol", F.explode(F.array_compact(F.array(*hits))).alias("issue"))


def naming_word_issues(entity: DataFrame) -> DataFrame:
    """Names that are a reserved word of their language, or hold a short word that is no common abbreviation."""
    reserved = _by_language(R.RESERVED_WORDS, "javascript", lambda words: F.col("symbol").isin(*words))
    short = F.exists(T.identifier_words(F.col("symbol")), lambda w: (F.length(w) <= 3) & ~F.lower(w).isin(*R.KNOWN_SHORT))
    made = F.array_compact(F.array(F.when(reserved, "reserved_word"), F.when(short, "uncommon_abbreviation")))
    return entity.filter(_own_name()).select("id", "project_id", "symbol", F.explode(made).alias("issue"))


def import_cycles(sourcecode: DataFrame) -> DataFrame:
    """Pairs of files of a project that name each other in import lines, by base name without extension."""
    base = F.regexp_extract("filename", r"([^/]*?)(?:\.\w+)?\z", 1)
    files = sourcecode.filter("filename IS NOT NULL AND project_id IS NOT NULL").select("project_id", "filename", base.alias("word")).filter("word <> ''").distinct()
    lines = F.regexp_extract_all("source", F.lit(R.IMPORT_LINE), 0)
    words = F.array_distinct(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"[\w-]+"), 0))))
    named = sourcecode.filter("source IS NOT NULL AND filename IS NOT NULL").select("project_id", F.col("filename").alias("importer"), F.explode(words).alias("word"))
    e = named.join(files, ["project_id", "word"]).filter("importer <> filename").select("project_id", F.col("importer").alias("file_a"), F.col("filename").alias("file_b")).distinct()
    back = e.select("project_id", F.col("file_b").alias("file_a"), F.col("file_a").alias("file_b"))
    return e.join(back, ["project_id", "file_a", "file_b"], "left_semi").filter("file_a < file_b")


def dashboard(project: DataFrame, entity: DataFrame, relationship: DataFrame) -> DataFrame:
    """Each project's functions, share of dead ones, documentation and health with its rating."""
    d = dead_code_summary(entity, relationship).select("project_id", "functions", "dead_functions", "entry_points")
    c = functions_of(entity).groupBy("project_id").agg(F.count_if(F.coalesce(F.col("comment") != "", F.lit(False))).alias("commented"))
    m = d.join(c, "project_id").withColumn("dead_pct", (F.col("dead_functions") + F.col("entry_points")) / F.col("functions") * 100).withColumn("doc_pct", F.floor(F.col("commented") / F.col("functions") * 100 + 0.5))
    m = m.withColumn("health", F.floor((F.greatest(F.lit(0.0), F.lit(100.0) - 2 * F.col("dead_pct")) + F.col("doc_pct")) / 2 + 0.5).cast("long"))
    return m.select("project_id", "functions", "commented", "health", F.when(F.col("health") >= 80, "excellent").when(F.col("health") >= 60, "good").when(F.col("health") >= 40, "fair").otherwise("poor").alias("rating"))


def duplicate_pairs(entity: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs of functions of a project, five lines and more, whose token sets are alike: in the same bucket of five tokens,
    in the same or adjacent buckets of ten lines, neither twice as long as the other, Jaccard ``threshold`` or more.

    Exact without comparing all pairs of a bucket: sets of that similarity share one of their rarest tokens, so only the
    first size - ceil(threshold * size) + 1 tokens by frequency are joined."""
    n = F.col("end_line") - F.col("start_line") + 1
    tokens = F.transform(T.tokens(F.col("source")), lambda x: F.xxhash64(x))  # hashes instead of words: less to shuffle
    f = functions_of(entity).filter(F.col("source").isNotNull() & (n >= 5)).select("id", "project_id", n.alias("lines"), tokens.alias("tokens"))
    f = stored(f.filter(F.size("tokens") > 0).withColumn("bucket", F.floor(F.size("tokens") / 5)).withColumn("line_bucket", F.floor(F.col("lines") / 10)), "tokens")
    flat = f.select("id", F.explode("tokens").alias("token"))
    freq = flat.groupBy("token").agg(F.count("*").alias("freq"))
    ranked = flat.join(freq, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("r"))
    keep = F.size("r") - F.ceil(F.lit(threshold) * F.size("r") - 1e-9) + 1
    keys = ranked.select("id", F.explode(F.slice("r", F.lit(1), keep.cast("int"))).alias("k")).select("id", F.col("k.token").alias("token"))
    keyed = keys.join(f.select("id", "project_id", "bucket", "line_bucket", "lines"), "id")
    a, b = keyed.alias("a"), keyed.alias("b")
    cond = (F.col("a.project_id") == F.col("b.project_id")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id"))
    cand = a.join(b, cond).filter((F.abs(F.col("a.line_bucket") - F.col("b.line_bucket")) <= 1) & (F.abs(F.col("a.lines") - F.col("b.lines")) <= 0.5 * F.greatest("a.lines", "b.lines"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
    t = f.select("id", "tokens")
    both = cand.join(t.select(F.col("id").alias("id_a"), F.col("tokens").alias("ta")), "id_a").join(t.select(F.col("id").alias("id_b"), F.col("tokens").alias("tb")), "id_b")
    s = F.size(F.array_intersect("ta", "tb"))
    return both.select("id_a", "id_b", (s / (F.size("ta") + F.size("tb") - s)).alias("similarity")).filter(F.col("similarity") >= threshold)


# ---------------------------------------------------------------- ingest: edges, merges, deletes


def resolve_calls(calls: DataFrame, entity: DataFrame) -> DataFrame:
    """(caller, callee, line) of calls {project_id, filename, line, symbol}: the caller is the smallest function around the
    line, the callee the function of that name in the file, else in the project, else anywhere; the lowest id of several."""
    f = functions_of(entity)
    around = calls.join(f.select("project_id", "filename", F.col("id").alias("caller"), F.col("symbol").alias("own"), "start_line", "end_line"), ["project_id", "filename"]).filter("line BETWEEN start_line AND end_line AND own <> symbol")
    caller = around.groupBy("project_id", "filename", "line", "symbol").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "caller")).alias("x")).select("project_id", "filename", "line", "symbol", "x.caller")
    in_file = f.groupBy("project_id", "filename", "symbol").agg(F.min("id").alias("i1"))
    in_project = f.groupBy("project_id", "symbol").agg(F.min("id").alias("i2"))
    anywhere = f.groupBy("symbol").agg(F.min("id").alias("i3"))
    out = caller.join(in_file, ["project_id", "filename", "symbol"], "left").join(in_project, ["project_id", "symbol"], "left").join(anywhere, "symbol", "left")
    return out.select("caller", F.coalesce("i1", "i2", "i3").alias("callee"), "line").filter("callee IS NOT NULL")


def newest(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by the order columns: what a bulk upsert leaves."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return table.withColumn("rank__", F.row_number().over(w)).filter("rank__ = 1").drop("rank__")


def without_project(tables: dict[str, DataFrame], project_id: int) -> dict[str, DataFrame]:
    """All tables after a project's deletion, edges by either end."""
    gone = tables["entity"].filter(F.col("project_id") == project_id).select("id")
    out = {n: t.filter(F.col("project_id").isNull() | (F.col("project_id") != project_id)) for n, t in tables.items() if "project_id" in t.columns}
    if "relationship" in tables:
        out["relationship"] = tables["relationship"].join(gone.withColumnRenamed("id", "caller"), "caller", "left_anti").join(gone.withColumnRenamed("id", "callee"), "callee", "left_anti")
    if "inheritance" in tables:
        out["inheritance"] = tables["inheritance"].join(gone.withColumnRenamed("id", "child_entity_id"), "child_entity_id", "left_anti")
    return out
