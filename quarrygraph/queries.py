"""The queries of the code-graph operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules as R
from .functions import text as T
from .operators import codegraph as G
from .operators import catalog, extraction, flow, hierarchy
from .plans.rounds import cut
from .sources.tables import bounded_batches, table


def _extends(spark: SparkSession, base: str) -> DataFrame:
    """The rows of inheritance that extend, with both classes in entity."""
    known = table(spark, base, "entity").select("id")
    rows = table(spark, base, "inheritance").filter(F.lower(F.trim("relationship_type")) == "extends").select(F.col("child_entity_id").alias("child"), F.col("parent_entity_id").alias("parent"))
    return rows.join(known.withColumnRenamed("id", "child"), "child", "left_semi").join(known.withColumnRenamed("id", "parent"), "parent", "left_semi")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    trees = hierarchy.forest(_extends(spark, base), paths=False)
    calls = hierarchy.circles(table(spark, base, "relationship"), "caller", "callee")
    return trees.selectExpr("'inheritance' AS graph", "node_id", "root_id", "depth").unionByName(calls.selectExpr("'call' AS graph", "node_id", "root_id", "-1 AS depth"))


def p6_paths(spark: SparkSession, base: str) -> DataFrame:
    """Every class of the hierarchy with its path as text, from the root down."""
    return hierarchy.forest(_extends(spark, base)).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


def p6_descendants(spark: SparkSession, base: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.forest(_extends(spark, base)))

DEPTH = 3


class Tables:
    """The tables of a directory by name, read where they are used."""

    def __init__(self, spark: SparkSession, base: str):
        self._spark, self._base = spark, base

    def __getattr__(self, name: str) -> DataFrame:
        return table(self._spark, self._base, name)


def _edges(t: Tables) -> DataFrame:
    return G.call_edges(t.relationship, t.entity)


def _rooted(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = _edges(t)
    return e, cut(G.busiest(e))


def _rooted_up(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = _edges(t)
    return e, cut(G.busiest(e, up=True))


def _dependencies(t: Tables) -> DataFrame:
    return G.file_dependencies(t.relationship, t.entity)


def _links(t: Tables) -> DataFrame:
    """Inheritance of any type between known classes."""
    i = t.inheritance.filter("parent_entity_id IS NOT NULL").select(F.col("child_entity_id").alias("child"), F.col("parent_entity_id").alias("parent")).distinct()
    ids = t.entity.select("id")
    return i.join(ids.withColumnRenamed("id", "child"), "child", "left_semi").join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi")


def _q(name: str, sql: str | None = None):
    """Registers a query of the tables and the SQL that gives the same rows."""

    def wrap(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, base: f(Tables(spark, base))
        if sql:
            SQL[name] = sql
        return f

    return wrap


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p6_found": p6_found, "p6_paths": p6_paths, "p6_descendants": p6_descendants}
SQL: dict[str, str] = {}


def _s(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_s(pattern)})"


def _n(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {_s(pattern)}))"


def _sum(terms: list[str]) -> str:
    return " + ".join(terms)


# ---------------------------------------------------------------- SQL pieces

_EXTENDS_SQL = """ext AS (SELECT child_entity_id AS child, min(parent_entity_id) AS parent FROM inheritance
    WHERE lower(trim(relationship_type)) = 'extends' AND child_entity_id IN (SELECT id FROM entity) AND parent_entity_id IN (SELECT id FROM entity) GROUP BY child_entity_id)"""
SQL["p6_found"] = f"""WITH RECURSIVE {_EXTENDS_SQL},
nodes AS (SELECT child AS id FROM ext UNION SELECT parent FROM ext),
up AS (SELECT id AS node, id AS cur, 0 AS depth, [id] AS seen FROM nodes
    UNION ALL SELECT up.node, ext.parent, up.depth + 1, list_append(up.seen, ext.parent) FROM up JOIN ext ON ext.child = up.cur WHERE NOT list_contains(up.seen, ext.parent)),
tip AS (SELECT node, arg_max(cur, depth) AS last, max(depth) AS depth, arg_max(seen, depth) AS seen FROM up GROUP BY node),
trees AS (SELECT 'inheritance' AS graph, tip.node AS node_id,
    CASE WHEN ext.parent IS NULL THEN tip.last ELSE list_min(tip.seen[list_position(tip.seen, ext.parent):]) END AS root_id,
    CASE WHEN ext.parent IS NULL THEN tip.depth ELSE -1 END AS depth FROM tip LEFT JOIN ext ON ext.child = tip.last),
calls AS (SELECT DISTINCT caller AS a, callee AS b FROM relationship WHERE caller IS NOT NULL AND callee IS NOT NULL),
reach AS (SELECT a, b FROM calls UNION SELECT reach.a, calls.b FROM reach JOIN calls ON calls.a = reach.b),
strong AS (SELECT x.a, min(x.b) AS low FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT graph, node_id, root_id, depth FROM trees UNION ALL SELECT 'call', a, low, -1 FROM strong"""
_E = "e AS (SELECT DISTINCT caller, callee, line FROM relationship WHERE line IS NOT NULL AND caller IN (SELECT id FROM entity) AND callee IN (SELECT id FROM entity)), root AS (SELECT caller AS node FROM e GROUP BY caller ORDER BY count(DISTINCT callee) DESC, caller LIMIT 1)"
_DOWN = f"down AS (SELECT node, 0 AS d FROM root UNION SELECT e.callee, down.d + 1 FROM down JOIN e ON e.caller = down.node WHERE down.d < {DEPTH})"
_UP = f"up AS (SELECT node, 0 AS d FROM root UNION SELECT e.caller, up.d + 1 FROM up JOIN e ON e.callee = up.node WHERE up.d < {DEPTH})"
_DE = f"de AS (SELECT e.caller, e.callee, e.line, min(down.d) + 1 AS depth FROM e JOIN down ON down.node = e.caller WHERE down.d < {DEPTH} GROUP BY ALL)"
_UE = f"ue AS (SELECT e.caller, e.callee, e.line, min(up.d) + 1 AS depth FROM e JOIN up ON up.node = e.callee WHERE up.d < {DEPTH} GROUP BY ALL)"
_CC = "CASE WHEN source IS NULL OR source = '' THEN 1 WHEN language = 'python' THEN 1 + {python} WHEN language = 'javascript' THEN 1 + {javascript} ELSE 1 + {c} END".format(**{k: _sum([_n("source", p) for p in v]) for k, v in T.DECISIONS.items()})
_BRACES = "list_reduce(list_concat([0::BIGINT], list_transform(regexp_extract_all(source, '[{}]'), lambda x: CASE WHEN x = '{' THEN 1::BIGINT ELSE -1::BIGINT END)), lambda a, x: greatest(a // 100000, greatest(a % 100000 + x, 0)) * 100000 + greatest(a % 100000 + x, 0)) // 100000"
_INDENT = "coalesce(list_max(list_transform(list_filter(string_split(source, chr(10)), lambda x: trim(x) <> ''), lambda x: CASE WHEN len(regexp_extract(x, '^(\\s*)', 1)) >= 4 THEN len(regexp_extract(x, '^(\\s*)', 1)) // 4 ELSE len(regexp_extract(x, '^(\\s*)', 1)) // 2 END)), 0)"
_NEST = f"CASE WHEN source IS NULL OR source = '' THEN 0 WHEN contains(source, '{{') THEN {_BRACES} ELSE {_INDENT} END"
_LOC = "CASE WHEN source IS NULL OR source = '' THEN 0 ELSE len(list_filter(string_split(source, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*(?://|#|\\*|/\\*|\\z)'))) END"
_INNER = "trim(regexp_replace(regexp_replace(parameters, '^\\(', ''), '\\)\\z', ''))"
_PARAMS = f"CASE WHEN parameters IS NULL OR parameters IN ('', '()') OR {_INNER} IN ('', 'void') THEN 0 ELSE list_reduce(list_concat([100000001::BIGINT], list_transform(regexp_extract_all({_INNER}, '[<>()\\[\\],]'), lambda x: CASE WHEN x IN ('<', '(', '[') THEN 1::BIGINT WHEN x = ',' THEN 0::BIGINT ELSE -1::BIGINT END)), lambda a, x: CASE WHEN x <> 0 THEN a + x * 100000 WHEN a // 100000 = 1000 THEN a + 1 ELSE a END) % 100000 END"
_M = f"m AS (SELECT id, project_id, symbol, filename, {_CC} AS cyclomatic, {_NEST} AS nesting, {_LOC} AS loc, {_PARAMS} AS params, end_line - start_line + 1 AS lines FROM entity WHERE type = 'function'), mr AS (SELECT *, CASE WHEN cyclomatic <= 5 THEN 'low' WHEN cyclomatic <= 10 THEN 'moderate' WHEN cyclomatic <= 20 THEN 'high' ELSE 'very_high' END AS rating FROM m)"
_DEP = "dep AS (SELECT a.project_id, a.filename AS source_file, b.filename AS target_file, count(*) AS calls, array_to_string(list_sort(list(DISTINCT a.symbol || ' -> ' || b.symbol))[1:5], '; ') AS examples FROM relationship r JOIN entity a ON a.id = r.caller JOIN entity b ON b.id = r.callee WHERE a.project_id = b.project_id AND a.filename <> b.filename GROUP BY ALL)"
_DEAD = f"dead AS (SELECT e.id, e.project_id, e.symbol, e.filename, e.end_line - e.start_line + 1 AS lines, {_has('e.symbol', R.ENTRY_POINTS)} OR {_has('e.symbol', R.ENTRY_POINTS_CASED)} AS entry_point FROM entity e WHERE e.type = 'function' AND NOT EXISTS (SELECT 1 FROM relationship r JOIN entity c ON c.id = r.caller WHERE r.callee = e.id AND c.project_id = e.project_id))"
_DEADSUM = f"{_DEAD}, ds AS (SELECT t.project_id, t.functions, t.total_lines, coalesce(u.dead_functions, 0) AS dead_functions, coalesce(u.entry_points, 0) AS entry_points, coalesce(u.dead_lines, 0)::BIGINT AS dead_lines FROM (SELECT project_id, count(*) AS functions, sum(end_line - start_line + 1)::BIGINT AS total_lines FROM entity WHERE type = 'function' GROUP BY project_id) t LEFT JOIN (SELECT project_id, count(*) FILTER (WHERE NOT entry_point) AS dead_functions, count(*) FILTER (WHERE entry_point) AS entry_points, sum(CASE WHEN entry_point THEN 0 ELSE lines END) AS dead_lines FROM dead GROUP BY project_id) u ON u.project_id = t.project_id)"
_STATUS = "st AS (SELECT id, project_id, symbol, filename, len(trim(coalesce(comment, ''))) > 10 AS has_comment, CASE WHEN NOT len(trim(coalesce(comment, ''))) > 10 THEN 'undocumented' WHEN len(list_filter(string_split(coalesce(parameters, ''), ','), lambda x: trim(x) <> '')) > 0 AND NOT regexp_matches(coalesce(comment, ''), '@param|:param|Args:|Parameters:') THEN 'partial_params' WHEN coalesce(return_type, '') <> '' AND return_type <> 'void' AND NOT regexp_matches(coalesce(comment, ''), '@returns?|:returns?:|Returns:') THEN 'partial_return' ELSE 'documented' END AS status FROM entity WHERE type = 'function')"
_NORM = "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(source, '(?m)//.*$', '', 'g'), '/\\*[\\s\\S]*?\\*/', '', 'g'), '(?m)#.*$', '', 'g'), '\\s+', ' ', 'g')))"


def _tri(x: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


# ---------------------------------------------------------------- lookups and counts


@_q("project_stats", "SELECT p.id AS project_id, p.name, coalesce(e.n, 0) AS entity_count, coalesce(s.n, 0) AS source_count FROM project p LEFT JOIN (SELECT project_id, count(*) AS n FROM entity GROUP BY 1) e ON e.project_id = p.id LEFT JOIN (SELECT project_id, count(*) AS n FROM sourcecode GROUP BY 1) s ON s.project_id = p.id")
def _(t: Tables) -> DataFrame:
    return G.project_stats(t.project, t.entity, t.sourcecode)


@_q("entity_list", "SELECT id, project_id, symbol, type, language, filename, start_line, end_line FROM entity")
def _(t: Tables) -> DataFrame:
    return G.entity_list(t.entity)


@_q("entity_search", f"SELECT id, symbol, type, filename, CASE WHEN len({_tri('symbol')}) + len({_tri(chr(39) + 'load' + chr(39))}) = 0 THEN 0.0 ELSE len(list_intersect({_tri('symbol')}, {_tri(chr(39) + 'load' + chr(39))})) / (len({_tri('symbol')}) + len({_tri(chr(39) + 'load' + chr(39))}) - len(list_intersect({_tri('symbol')}, {_tri(chr(39) + 'load' + chr(39))})))::DOUBLE END AS similarity, symbol ILIKE 'load%' AS prefix FROM entity WHERE symbol ILIKE '%load%' ORDER BY symbol ILIKE 'load%' DESC, lower(symbol), id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return G.entity_search(t.entity, "load")


@_q("functions_per_file", "SELECT project_id, filename, count(*) AS functions FROM entity WHERE type = 'function' GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return G.functions_per_file(t.entity)


@_q("files_with_counts", "SELECT s.project_id, s.filename, count(e.id) AS functions FROM (SELECT DISTINCT project_id, filename FROM sourcecode) s LEFT JOIN entity e ON e.project_id = s.project_id AND e.filename = s.filename AND e.type = 'function' GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return G.files_with_counts(t.sourcecode, t.entity)


@_q("global_stats", "SELECT (SELECT count(*) FROM project) AS projects, (SELECT count(*) FROM entity) AS entities, (SELECT count(DISTINCT language) FROM entity) AS languages, (SELECT count(*) FROM sourcecode) AS files")
def _(t: Tables) -> DataFrame:
    return G.global_stats(t.project, t.entity, t.sourcecode)


@_q("definitions_by_name", "SELECT e.id, e.symbol, e.type, e.filename, e.start_line, coalesce(p.name, 'Unknown') AS project_name FROM entity e LEFT JOIN project p ON p.id = e.project_id WHERE e.type IN ('class', 'struct')")
def _(t: Tables) -> DataFrame:
    return G.definitions_by_name(t.entity, t.project)


@_q("first_entity_per_symbol", "SELECT symbol, type, min(id) AS id, arg_min(project_id, id) AS project_id, arg_min(filename, id) AS filename FROM entity GROUP BY symbol, type")
def _(t: Tables) -> DataFrame:
    return G.first_entity_per_symbol(t.entity)


@_q("class_members", "SELECT c.id AS class_id, c.symbol AS class_symbol, m.id AS member_id, m.symbol AS member_symbol FROM entity c JOIN entity m ON m.project_id = c.project_id AND m.filename = c.filename AND m.start_line > c.start_line AND m.end_line < c.end_line WHERE c.type IN ('class', 'struct') AND m.type = 'function'")
def _(t: Tables) -> DataFrame:
    return G.class_members(t.entity)


@_q("read_source_slice", "SELECT id, array_to_string(string_split(source, chr(10))[3:12], chr(10)) AS text FROM sourcecode WHERE source IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return G.read_source_slice(t.sourcecode, 3, 12)


# ---------------------------------------------------------------- symbol occurrences


@_q("find_references", "SELECT project_id, symbol, filename, count(*) AS total, count(*) FILTER (WHERE is_definition) AS definitions, count(*) FILTER (WHERE is_write AND NOT is_definition) AS writes, count(*) FILTER (WHERE NOT is_write AND NOT is_definition) AS reads FROM symbol_reference GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return G.find_references(t.symbol_reference, t.entity)


@_q("go_to_definition", "WITH a AS (SELECT project_id, symbol, 0 AS r, filename, line FROM symbol_reference WHERE is_definition UNION ALL SELECT project_id, symbol, 1, filename, start_line FROM entity) SELECT project_id, symbol, CASE WHEN r = 0 THEN 'occurrence' ELSE 'entity' END AS found_in, filename, line FROM (SELECT *, row_number() OVER (PARTITION BY project_id, symbol ORDER BY r, filename NULLS FIRST, line NULLS FIRST) AS k FROM a) WHERE k = 1")
def _(t: Tables) -> DataFrame:
    return G.go_to_definition(t.symbol_reference, t.entity)


@_q("list_definitions", "SELECT project_id, symbol_type, filename, count(*) AS definitions FROM symbol_reference WHERE is_definition GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return G.list_definitions(t.symbol_reference)


@_q("reference_summary", "SELECT symbol, symbol_type, count(*) AS reference_count, count(*) FILTER (WHERE is_definition) AS definition_count, count(*) FILTER (WHERE is_write) AS write_count FROM symbol_reference GROUP BY ALL ORDER BY reference_count DESC, symbol, symbol_type LIMIT 100")
def _(t: Tables) -> DataFrame:
    return G.reference_summary(t.symbol_reference)


@_q("symbols_at", "SELECT r.id, r.filename, r.line, coalesce(r.column_start, 0) AS column_from, r.column_end, r.symbol, e.symbol AS definition_symbol, e.start_line AS definition_line FROM symbol_reference r LEFT JOIN entity e ON e.id = r.definition_entity_id")
def _(t: Tables) -> DataFrame:
    return G.symbols_at(t.symbol_reference, t.entity)


@_q("entity_references", "SELECT r.id AS reference_id, e.id AS entity_id, r.filename, r.line, r.symbol_type FROM symbol_reference r JOIN entity e ON e.project_id = r.project_id AND e.symbol = r.symbol AND e.filename = r.filename WHERE NOT r.is_definition")
def _(t: Tables) -> DataFrame:
    r = t.symbol_reference.filter("NOT is_definition").select(F.col("id").alias("reference_id"), "project_id", "symbol", "filename", "line", "symbol_type")
    return r.join(t.entity.select(F.col("id").alias("entity_id"), "project_id", "symbol", "filename"), ["project_id", "symbol", "filename"]).select("reference_id", "entity_id", "filename", "line", "symbol_type")


# ---------------------------------------------------------------- calls


_CALLS_SQL = "SELECT r.id AS call_id, r.caller, a.symbol AS caller_symbol, r.callee, b.symbol AS callee_symbol, r.line FROM relationship r JOIN entity a ON a.id = r.caller JOIN entity b ON b.id = r.callee"


@_q("function_callers", f"SELECT callee, callee_symbol, count(*) AS calls, count(DISTINCT caller) AS callers, min(caller_symbol) AS first_caller FROM ({_CALLS_SQL}) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return G.function_calls(t.relationship, t.entity).groupBy("callee", "callee_symbol").agg(F.count("*").alias("calls"), F.countDistinct("caller").alias("callers"), F.min("caller_symbol").alias("first_caller"))


@_q("function_callees", _CALLS_SQL)
def _(t: Tables) -> DataFrame:
    return G.function_calls(t.relationship, t.entity)


@_q("call_graph_edges", f"WITH RECURSIVE {_E}, {_DOWN}, {_UP}, {_DE}, {_UE} SELECT coalesce(de.caller, ue.caller) AS caller, coalesce(de.callee, ue.callee) AS callee, coalesce(de.line, ue.line) AS line, de.depth AS callee_depth, ue.depth AS caller_depth FROM de FULL JOIN ue ON de.caller = ue.caller AND de.callee = ue.callee AND de.line = ue.line")
def _(t: Tables) -> DataFrame:
    return G.call_graph_edges(*_rooted(t), DEPTH)


@_q("call_graph_nodes", f"WITH RECURSIVE {_E}, {_DOWN}, {_UP} SELECT n.node, e2.symbol, e2.type, e2.filename, n.node IN (SELECT node FROM root) AS is_root FROM (SELECT node FROM down UNION SELECT node FROM up) n JOIN entity e2 ON e2.id = n.node")
def _(t: Tables) -> DataFrame:
    return G.call_graph_nodes(*_rooted(t), DEPTH, t.entity)


_E_UP = _E.replace("SELECT caller AS node FROM e GROUP BY caller ORDER BY count(DISTINCT callee) DESC, caller", "SELECT callee AS node FROM e GROUP BY callee ORDER BY count(DISTINCT caller) DESC, callee")


@_q("reverse_call_graph", f"WITH RECURSIVE {_E_UP}, {_UP}, {_UE} SELECT * FROM ue")
def _(t: Tables) -> DataFrame:
    return G.reach_edges(*_rooted_up(t), DEPTH, up=True)


@_q("call_heatmap", f"WITH RECURSIVE {_E}, {_DOWN}, {_DE}, n AS (SELECT node, count(*) AS caller_count FROM (SELECT callee AS node FROM de UNION ALL SELECT node FROM root) GROUP BY node) SELECT node, caller_count, caller_count / max(caller_count) OVER ()::DOUBLE AS heat FROM n")
def _(t: Tables) -> DataFrame:
    return G.call_heatmap(*_rooted(t), DEPTH)


def _tree_sql(a: str, b: str, e: str = _E) -> str:
    return f"WITH RECURSIVE {e}, p AS (SELECT DISTINCT {a} AS node, {b} AS next FROM e), w AS (SELECT p.node, p.next, 1 AS depth, [p.node, p.next] AS path, p.node = p.next AS ended FROM p JOIN root USING (node) UNION ALL SELECT p.node, p.next, w.depth + 1, list_append(w.path, p.next), list_contains(w.path, p.next) FROM w JOIN p ON p.node = w.next WHERE w.depth < {DEPTH} AND NOT w.ended) SELECT node, next, depth, array_to_string(path, '>') AS path FROM w"


@_q("callee_tree_edges", _tree_sql("caller", "callee"))
def _(t: Tables) -> DataFrame:
    return G.tree_edges(*_rooted(t), DEPTH)


@_q("caller_tree_edges", _tree_sql("callee", "caller", _E_UP))
def _(t: Tables) -> DataFrame:
    return G.tree_edges(*_rooted_up(t), DEPTH, up=True)


@_q("file_dependencies", f"WITH {_DEP} SELECT * FROM dep")
def _(t: Tables) -> DataFrame:
    return _dependencies(t)


@_q("file_coupling", f"WITH {_DEP}, x AS (SELECT project_id, source_file AS filename, count(*) AS efferent FROM dep GROUP BY ALL), y AS (SELECT project_id, target_file AS filename, count(*) AS afferent FROM dep GROUP BY ALL) SELECT coalesce(x.project_id, y.project_id) AS project_id, coalesce(x.filename, y.filename) AS filename, coalesce(efferent, 0) AS efferent, coalesce(afferent, 0) AS afferent, floor(coalesce(efferent, 0) / (coalesce(efferent, 0) + coalesce(afferent, 0)) * 100 + 0.5) / 100.0::DOUBLE AS instability FROM x FULL JOIN y ON x.project_id = y.project_id AND x.filename = y.filename")
def _(t: Tables) -> DataFrame:
    return G.file_coupling(cut(_dependencies(t)))


@_q("circular_dependencies", f"WITH {_DEP} SELECT x.project_id, x.source_file AS file_a, x.target_file AS file_b FROM dep x JOIN dep y ON x.project_id = y.project_id AND x.source_file = y.target_file AND x.target_file = y.source_file WHERE x.source_file < x.target_file")
def _(t: Tables) -> DataFrame:
    return G.circular_dependencies(cut(_dependencies(t)))


# ---------------------------------------------------------------- classes

SQL["p6_descendants"] = f"""WITH RECURSIVE {_EXTENDS_SQL},
up AS (SELECT child AS node, parent AS cur, 1 AS d, [child, parent] AS seen FROM ext WHERE child <> parent UNION ALL SELECT up.node, ext.parent, up.d + 1, list_append(up.seen, ext.parent) FROM up JOIN ext ON ext.child = up.cur WHERE NOT list_contains(up.seen, ext.parent)),
good AS (SELECT node FROM up WHERE cur NOT IN (SELECT child FROM ext))
SELECT cur AS node_id, node AS descendant_id, d AS distance FROM up WHERE node IN (SELECT node FROM good)"""


@_q("class_ancestors", SQL["p6_descendants"].replace("cur AS node_id, node AS descendant_id, d AS distance", "node AS class_id, cur AS ancestor_id, d AS distance"))
def _(t: Tables) -> DataFrame:
    return hierarchy.descendants(hierarchy.forest(_extends(t._spark, t._base))).select(F.col("descendant_id").alias("class_id"), F.col("node_id").alias("ancestor_id"), "distance")


@_q("implementations", "SELECT DISTINCT i.child_entity_id, i.parent_symbol, lower(trim(i.relationship_type)) AS relationship_type, e.symbol AS child_symbol FROM inheritance i JOIN entity e ON e.id = i.child_entity_id")
def _(t: Tables) -> DataFrame:
    return G.implementations(t.inheritance, t.entity)


@_q("hierarchy_stats", "SELECT lower(trim(relationship_type)) AS relationship_type, count(*) AS n, count(DISTINCT child_entity_id) AS children FROM inheritance GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return G.hierarchy_counts(t.inheritance)


@_q("hierarchy_roots_leaves", "WITH l AS (SELECT DISTINCT child_entity_id AS child, parent_entity_id AS parent FROM inheritance WHERE child_entity_id IN (SELECT id FROM entity) AND parent_entity_id IN (SELECT id FROM entity)) SELECT DISTINCT parent AS id, 'root' AS role FROM l WHERE parent NOT IN (SELECT child FROM l) UNION ALL SELECT DISTINCT child, 'leaf' FROM l WHERE child NOT IN (SELECT parent FROM l)")
def _(t: Tables) -> DataFrame:
    return G.roots_and_leaves(cut(_links(t)))


# ---------------------------------------------------------------- analyses


@_q("dead_code", f"WITH {_DEAD} SELECT * FROM dead")
def _(t: Tables) -> DataFrame:
    return G.dead_code(t.entity, t.relationship)


@_q("dead_code_summary", f"WITH {_DEADSUM} SELECT *, floor(CASE WHEN total_lines > 0 THEN dead_lines / total_lines * 100 ELSE 0.0 END * 10 + 0.5) / 10.0::DOUBLE AS dead_pct FROM ds")
def _(t: Tables) -> DataFrame:
    return G.dead_code_summary(t.entity, t.relationship)


@_q("function_complexity", f"WITH {_M} SELECT * FROM mr")
def _(t: Tables) -> DataFrame:
    return G.function_complexity(t.entity)


@_q("file_metrics", f"WITH {_M} SELECT project_id, filename, count(*) AS functions, sum(cyclomatic)::BIGINT AS total_cyclomatic, max(cyclomatic) AS max_cyclomatic, sum(loc)::BIGINT AS total_loc, max(nesting) AS max_nesting FROM mr GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return G.file_metrics(G.function_complexity(t.entity))


@_q("code_metrics", f"WITH {_M}, g AS (SELECT project_id, count(*) AS functions, floor(avg(cyclomatic) * 10 + 0.5) / 10.0::DOUBLE AS avg_cyclomatic, max(cyclomatic) AS max_cyclomatic, floor(avg(loc) * 10 + 0.5) / 10.0::DOUBLE AS avg_loc, count(*) FILTER (WHERE rating = 'low') AS low_count, count(*) FILTER (WHERE rating = 'moderate') AS moderate_count, count(*) FILTER (WHERE rating = 'high') AS high_count, count(*) FILTER (WHERE rating = 'very_high') AS very_high_count FROM mr GROUP BY project_id), h AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 171.0::DOUBLE - 5.2::DOUBLE * ln(CASE WHEN avg_loc = 0 THEN 1 ELSE avg_loc END * CASE WHEN avg_cyclomatic = 0 THEN 1 ELSE avg_cyclomatic END) - 0.23::DOUBLE * CASE WHEN avg_cyclomatic = 0 THEN 1 ELSE avg_cyclomatic END - 16.2::DOUBLE * ln(CASE WHEN avg_loc = 0 THEN 1 ELSE avg_loc END))) AS mi FROM g) SELECT * EXCLUDE (mi), floor(mi + 0.5)::BIGINT AS maintainability, CASE WHEN mi >= 80 THEN 'High' WHEN mi >= 60 THEN 'Medium' WHEN mi >= 40 THEN 'Low' ELSE 'Very Low' END AS maintainability_rating FROM h")
def _(t: Tables) -> DataFrame:
    return G.code_metrics(G.function_complexity(t.entity))


@_q("code_smells", f"WITH {_M} SELECT id, project_id, symbol, 'long_method' AS smell, lines::BIGINT AS value, CASE WHEN lines > 200 THEN 'high' ELSE 'medium' END AS severity FROM mr WHERE lines > 50 UNION ALL SELECT id, project_id, symbol, 'god_function', lines, 'high' FROM mr WHERE lines > 200 UNION ALL SELECT id, project_id, symbol, 'long_parameter_list', params, CASE WHEN params > 8 THEN 'high' ELSE 'medium' END FROM mr WHERE params > 5 UNION ALL SELECT id, project_id, symbol, 'high_complexity', cyclomatic, CASE WHEN cyclomatic > 25 THEN 'high' ELSE 'medium' END FROM mr WHERE cyclomatic > 15 UNION ALL SELECT id, project_id, symbol, 'deep_nesting', nesting, CASE WHEN nesting > 6 THEN 'high' ELSE 'medium' END FROM mr WHERE nesting > 4")
def _(t: Tables) -> DataFrame:
    return G.code_smells(G.function_complexity(t.entity))


@_q("name_suspects", "SELECT *, CASE WHEN n > 5 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT project_id, regexp_replace(symbol, '[0-9]+\\z', '') AS base_name, count(*) AS n FROM entity WHERE type = 'function' GROUP BY ALL) WHERE n > 2 AND len(base_name) > 3")
def _(t: Tables) -> DataFrame:
    return G.name_suspects(t.entity)


@_q("security_findings", " UNION ALL ".join(f"SELECT id, project_id, filename, '{k}' AS rule, '{sev}' AS severity FROM entity WHERE type = 'function' AND ({' OR '.join(_has('source', p) for p in pats)})" for k, (sev, pats) in R.SECURITY.items()))
def _(t: Tables) -> DataFrame:
    return G.security_findings(t.entity)


_HINT = "(language = 'python' AND coalesce(regexp_matches(source, '->\\s*\\w+'), false)) OR (language = 'javascript' AND coalesce(return_type <> '' AND return_type <> 'function', false))"


@_q("type_inference", f"SELECT id, project_id, symbol, language, {_HINT} AS has_hint, CASE WHEN {_HINT} THEN NULL WHEN source IS NULL OR regexp_extract(source, 'return\\s+([^;}}\\n]+)', 1) = '' THEN 'unknown' " + " ".join(f"WHEN regexp_matches(regexp_extract(source, 'return\\s+([^;}}\\n]+)', 1), {_s(p)}) THEN '{k}'" for k, p in R.RETURN_TYPES) + " ELSE 'unknown' END AS inferred FROM entity WHERE type = 'function' AND language IN ('javascript', 'python', 'ruby', 'php')")
def _(t: Tables) -> DataFrame:
    return G.type_inference(t.entity)


_PRIV = " OR ".join(f"{_has('e.symbol', p)} OR coalesce({_has('e.source', p)}, false)" for p in R.PRIVATE)


@_q("api_surface", f"WITH n AS (SELECT callee, count(*) AS callers FROM relationship WHERE callee IS NOT NULL GROUP BY 1) SELECT e.id, e.project_id, e.symbol, {_PRIV} AS is_private, coalesce(len(e.comment), 0) > 0 AS documented, CASE WHEN coalesce(e.parameters, '') = '' THEN 0 ELSE len(string_split(e.parameters, ',')) END AS params, coalesce(n.callers, 0) AS callers, NOT ({_PRIV}) AND (coalesce(n.callers, 0) >= 3 OR {_has('e.symbol', R.API_ENTRIES)}) AS entry_point FROM entity e LEFT JOIN n ON n.callee = e.id WHERE e.type = 'function'")
def _(t: Tables) -> DataFrame:
    return G.api_surface(t.entity, t.relationship)


@_q("doc_status", f"WITH {_STATUS} SELECT * FROM st")
def _(t: Tables) -> DataFrame:
    return G.doc_status(t.entity)


@_q("doc_coverage", f"WITH {_STATUS} SELECT project_id, filename, count(*) AS functions, count(*) FILTER (WHERE has_comment) AS commented, floor(count(*) FILTER (WHERE has_comment) / count(*) * 100 + 0.5)::BIGINT AS coverage FROM st GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return G.doc_coverage(G.doc_status(t.entity))


_NAMES = "list_concat(regexp_extract_all(source, '\\b(?:let|const)\\s+(\\w+)', 1), regexp_extract_all(source, '\\bvar\\s+(\\w+)', 1))"


@_q("scope_issues", "SELECT id, project_id, 'global' AS issue, 1 AS n FROM entity WHERE type = 'function' AND (" + " OR ".join(f"(language = '{k}' AND {_has('source', p)})" for k, p in R.GLOBALS.items()) + f") UNION ALL SELECT id, project_id, 'shadowing', (len({_NAMES}) - len(list_distinct({_NAMES})))::INTEGER FROM entity WHERE type = 'function' AND language IN ('javascript', 'typescript') AND len({_NAMES}) > len(list_distinct({_NAMES})) UNION ALL SELECT id, project_id, 'closure', 1 FROM entity WHERE type = 'function' AND language IN ('javascript', 'typescript') AND regexp_matches(source, '\\blet\\s+\\w+') AND regexp_matches(source, '\\.(forEach|map|filter|reduce)\\s*\\(')")
def _(t: Tables) -> DataFrame:
    return G.scope_issues(t.entity)


_STYLE_LIST = "list_filter([" + ", ".join(f"CASE WHEN {_has('symbol', p)} THEN '{k}' END" for k, p in R.STYLES.items()) + "], lambda x: x IS NOT NULL)"
_OWN = "NOT (symbol LIKE '\\_\\_%' ESCAPE '\\' AND symbol LIKE '%\\_\\_' ESCAPE '\\') AND NOT starts_with(symbol, '$')"
_WANT = "CASE " + " ".join(f"WHEN language = '{lang}' AND type = '{kind}' THEN {R.EXPECTED_STYLES.get((lang, kind), var)!r}" for lang, var in R.VARIABLE_STYLES.items() for kind in ("function", "class", "struct")) + " END"


@_q("naming_compliance", f"SELECT id, project_id, symbol, CASE WHEN len({_STYLE_LIST}) = 0 THEN 'unknown' ELSE array_to_string({_STYLE_LIST}, ',') END AS detected, coalesce(list_has_any({_STYLE_LIST}, {_WANT}), true) AS compliant FROM entity WHERE {_OWN}")
def _(t: Tables) -> DataFrame:
    return G.naming_compliance(t.entity)


def _eh(i: int) -> str:
    return "CASE " + " ".join(f"WHEN language = '{k}' THEN {_n('source', v[i])}" for k, v in R.ERROR_HANDLING.items()) + " ELSE 0 END"


@_q("error_handling", f"SELECT *, CASE WHEN handled = 0 THEN 'none' WHEN empty > handled / 2 THEN 'poor' WHEN finally_blocks > 0 THEN 'good' ELSE 'moderate' END AS coverage FROM (SELECT id, project_id, {_eh(0)} AS handled, {_eh(1)} AS empty, {_eh(2)} AS finally_blocks FROM entity WHERE type = 'function' AND source IS NOT NULL AND language IN ({', '.join(repr(k) for k in R.ERROR_HANDLING)}))")
def _(t: Tables) -> DataFrame:
    return G.error_handling(t.entity)


_LISTED = ", ".join(f"'{x}'" for x in R.CONCURRENCY if x != "javascript")
_CONC = " UNION ALL ".join(f"SELECT id, project_id, '{c}' AS category, '{k}' AS kind FROM entity WHERE type = 'function' AND " + (f"language = '{lang}'" if lang != "javascript" else f"language NOT IN ({_LISTED})") + f" AND {_has('source', p)}" for lang, rows in R.CONCURRENCY.items() for c, k, p in rows)


@_q("concurrency_findings", _CONC)
def _(t: Tables) -> DataFrame:
    return G.concurrency_findings(t.entity)


@_q("concurrency_warnings")  # its SQL is in report_queries
def _(t: Tables) -> DataFrame:
    return G.concurrency_warnings(G.concurrency_findings(t.entity))


@_q("resource_findings")  # its SQL is in report_queries
def _(t: Tables) -> DataFrame:
    return G.resource_findings(t.entity)


_TF = "CASE " + " ".join(f"WHEN language = '{k}' THEN {_has('filename', p)}" for k, p in R.TEST_FILES.items()) + f" ELSE {_has('filename', R.TEST_FILES['javascript'])} END"


def _sums(table: dict) -> str:
    one = lambda patterns: _sum([_n("coalesce(source, '')", p) for p in patterns])
    return "CASE " + " ".join(f"WHEN language = '{k}' THEN {one(p)}" for k, p in table.items()) + f" ELSE {one(table['javascript'])} END"


_AS = _sums(R.ASSERTIONS)


@_q("test_coverage", f"SELECT project_id, count(DISTINCT filename) FILTER (WHERE is_test) AS test_files, count(DISTINCT filename) FILTER (WHERE NOT is_test) AS other_files, count(*) FILTER (WHERE is_test) AS test_functions, sum(CASE WHEN is_test THEN asserts ELSE 0 END)::BIGINT AS assertions FROM (SELECT project_id, filename, {_TF} AS is_test, {_AS} AS asserts FROM entity WHERE type = 'function' AND filename IS NOT NULL) GROUP BY project_id")
def _(t: Tables) -> DataFrame:
    return G.test_coverage(t.entity)


@_q("design_patterns")  # its SQL is in report_queries
def _(t: Tables) -> DataFrame:
    return G.design_patterns(t.entity)


@_q("coverage_gaps", f"WITH f AS (SELECT DISTINCT project_id, filename, {_TF} AS is_test FROM entity WHERE type = 'function' AND filename IS NOT NULL) SELECT project_id, filename FROM f WHERE NOT is_test AND NOT EXISTS (SELECT 1 FROM f t WHERE t.is_test AND t.project_id = f.project_id AND contains(t.filename, string_split(regexp_replace(f.filename, '\\.\\w+\\z', ''), '/')[-1]))")
def _(t: Tables) -> DataFrame:
    return G.coverage_gaps(t.entity)


def _score(v: str, a: int, b: int, c: int, d: int) -> str:
    return f"(CASE WHEN {v} <= {a} THEN 100.0 WHEN {v} <= {b} THEN 85.0 WHEN {v} <= {c} THEN 70.0 WHEN {v} <= {d} THEN 50.0 ELSE greatest(0.0, 50.0 - ({v} - {d}) * 2.0) END)::DOUBLE"


_WORDS = "list_filter(regexp_extract_all(source, '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\b', 1), lambda w: len(w) > 1 OR w IN ('i', 'j', 'k', 'n', 'x', 'y', 'z'))"


@_q("readability", f"SELECT id, project_id, identifier_score, longest_line, boolean_operators, {_score('lines', 20, 50, 100, 200)} AS length_score, {_score('boolean_operators', 2, 3, 5, 7)} AS boolean_score FROM (SELECT id, project_id, end_line - start_line + 1 AS lines, CASE WHEN len({_WORDS}) = 0 THEN 100 ELSE floor(len(list_filter({_WORDS}, lambda w: len(w) BETWEEN 3 AND 25)) / len({_WORDS}) * 100 + 0.5) END::BIGINT AS identifier_score, list_max(list_transform(string_split(source, chr(10)), lambda x: len(x)))::BIGINT AS longest_line, list_max(list_transform(string_split(source, chr(10)), lambda x: len(regexp_extract_all(x, '(?i)&&|\\|\\||and\\s|or\\s|\\bnot\\s'))))::BIGINT AS boolean_operators FROM entity WHERE type = 'function' AND source <> '')")
def _(t: Tables) -> DataFrame:
    return G.readability(t.entity)


@_q("readability_score")
def _(t: Tables) -> DataFrame:
    return G.readability_score(t.entity)


_RESERVED = "CASE " + " ".join(f"WHEN language = '{k}' THEN symbol IN ({', '.join(map(repr, v))})" for k, v in R.RESERVED_WORDS.items()) + f" ELSE symbol IN ({', '.join(map(repr, R.RESERVED_WORDS['javascript']))}) END"
_SHORT = f"len(list_filter(string_split_regex(regexp_replace(symbol, '([A-Z])', '_\\1', 'g'), '[_-]'), lambda w: len(w) BETWEEN 1 AND 3 AND lower(w) NOT IN ({', '.join(map(repr, R.KNOWN_SHORT))}))) > 0"


@_q("naming_issues", " UNION ALL ".join(f"SELECT id, project_id, symbol, '{k}' AS issue FROM entity WHERE {_OWN} AND {_has('symbol', p)}" for k, p in R.NAME_ISSUES.items()))
def _(t: Tables) -> DataFrame:
    return G.naming_issues(t.entity)


@_q("naming_word_issues", f"SELECT id, project_id, symbol, 'reserved_word' AS issue FROM entity WHERE {_OWN} AND {_RESERVED} UNION ALL SELECT id, project_id, symbol, 'uncommon_abbreviation' FROM entity WHERE {_OWN} AND {_SHORT}")
def _(t: Tables) -> DataFrame:
    return G.naming_word_issues(t.entity)


@_q("import_cycles", f"WITH f AS (SELECT DISTINCT project_id, filename, regexp_extract(filename, '([^/]*?)(?:\\.\\w+)?\\z', 1) AS word FROM sourcecode), w AS (SELECT DISTINCT project_id, filename AS importer, unnest(flatten(list_transform(regexp_extract_all(source, {_s(R.IMPORT_LINE)}), lambda x: regexp_extract_all(x, '[\\w-]+')))) AS word FROM sourcecode WHERE source IS NOT NULL), e AS (SELECT DISTINCT w.project_id, w.importer AS file_a, f.filename AS file_b FROM w JOIN f ON f.project_id = w.project_id AND f.word = w.word WHERE f.word <> '' AND w.importer <> f.filename) SELECT x.project_id, x.file_a, x.file_b FROM e x JOIN e y ON x.project_id = y.project_id AND x.file_a = y.file_b AND x.file_b = y.file_a WHERE x.file_a < x.file_b")
def _(t: Tables) -> DataFrame:
    return G.import_cycles(t.sourcecode)


@_q("dashboard", f"WITH {_DEADSUM}, c AS (SELECT project_id, count(*) FILTER (WHERE comment <> '') AS commented FROM entity WHERE type = 'function' GROUP BY 1), h AS (SELECT ds.project_id, functions, commented, floor((greatest(0.0, 100.0 - 2 * ((dead_functions + entry_points) / functions * 100)) + floor(commented / functions * 100 + 0.5)) / 2 + 0.5)::BIGINT AS health FROM ds JOIN c ON c.project_id = ds.project_id) SELECT *, CASE WHEN health >= 80 THEN 'excellent' WHEN health >= 60 THEN 'good' WHEN health >= 40 THEN 'fair' ELSE 'poor' END AS rating FROM h")
def _(t: Tables) -> DataFrame:
    return G.dashboard(t.project, t.entity, t.relationship)


@_q("duplicate_pairs", f"WITH f AS MATERIALIZED (SELECT id, project_id, lines, tokens, len(tokens) // 5 AS bucket, lines // 10 AS lb FROM (SELECT id, project_id, end_line - start_line + 1 AS lines, list_distinct(list_filter(regexp_split_to_array({_NORM}, '\\s+'), lambda x: len(x) > 2)) AS tokens FROM entity WHERE type = 'function' AND source IS NOT NULL AND end_line - start_line + 1 >= 5) WHERE len(tokens) > 0), p AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.tokens, b.tokens)) AS s, len(a.tokens) + len(b.tokens) AS u FROM f a JOIN f b ON a.project_id = b.project_id AND a.bucket = b.bucket AND a.id < b.id WHERE abs(a.lb - b.lb) <= 1 AND abs(a.lines - b.lines) <= 0.5 * greatest(a.lines, b.lines)) SELECT id_a, id_b, s / (u - s)::DOUBLE AS similarity FROM p WHERE s / (u - s) >= 0.7")
def _(t: Tables) -> DataFrame:
    return G.duplicate_pairs(t.entity)


# ---------------------------------------------------------------- merges and deletes


@_q("entity_upsert", "SELECT project_id, language, symbol, type, filename, id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY project_id, language, symbol, type, filename ORDER BY updated_at DESC NULLS LAST, id DESC) AS k FROM entity) WHERE k = 1")
def _(t: Tables) -> DataFrame:
    e = t.entity.select("project_id", "language", "symbol", "type", "filename", "id", "updated_at")
    return G.newest(e, ["project_id", "language", "symbol", "type", "filename"], ["updated_at", "id"])


@_q("sourcecode_upsert", "SELECT project_id, filename, id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY project_id, filename ORDER BY updated_at DESC NULLS LAST, id DESC) AS k FROM sourcecode) WHERE k = 1")
def _(t: Tables) -> DataFrame:
    return G.newest(t.sourcecode.select("project_id", "filename", "id", "updated_at"), ["project_id", "filename"], ["updated_at", "id"])


@_q("project_delete_remaining", "WITH gone AS (SELECT id FROM entity WHERE project_id = 1) SELECT 'entity' AS name, count(*) AS n FROM entity WHERE project_id IS NULL OR project_id <> 1 UNION ALL SELECT 'sourcecode', count(*) FROM sourcecode WHERE project_id IS NULL OR project_id <> 1 UNION ALL SELECT 'relationship', count(*) FROM relationship WHERE (caller IS NULL OR caller NOT IN (FROM gone)) AND (callee IS NULL OR callee NOT IN (FROM gone)) UNION ALL SELECT 'inheritance', count(*) FROM inheritance WHERE child_entity_id NOT IN (FROM gone)")
def _(t: Tables) -> DataFrame:
    left = G.without_project({n: getattr(t, n) for n in ("entity", "sourcecode", "relationship", "inheritance")}, 1)
    out = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@_q("resolve_calls", "WITH c AS (SELECT DISTINCT project_id, filename, line, symbol FROM symbol_reference WHERE symbol_type = 'function' AND NOT is_definition), f AS (SELECT * FROM entity WHERE type = 'function'), k AS (SELECT c.*, f.id AS caller, row_number() OVER (PARTITION BY c.project_id, c.filename, c.line, c.symbol ORDER BY f.end_line - f.start_line, f.id) AS r FROM c JOIN f ON f.project_id = c.project_id AND f.filename = c.filename AND c.line BETWEEN f.start_line AND f.end_line AND f.symbol <> c.symbol), i1 AS (SELECT project_id, filename, symbol, min(id) AS i FROM f GROUP BY ALL), i2 AS (SELECT project_id, symbol, min(id) AS i FROM f GROUP BY ALL), i3 AS (SELECT symbol, min(id) AS i FROM f GROUP BY ALL) SELECT k.caller, coalesce(i1.i, i2.i, i3.i) AS callee, k.line FROM k LEFT JOIN i1 ON i1.project_id = k.project_id AND i1.filename = k.filename AND i1.symbol = k.symbol LEFT JOIN i2 ON i2.project_id = k.project_id AND i2.symbol = k.symbol LEFT JOIN i3 ON i3.symbol = k.symbol WHERE k.r = 1 AND coalesce(i1.i, i2.i, i3.i) IS NOT NULL")
def _(t: Tables) -> DataFrame:
    calls = t.symbol_reference.filter("symbol_type = 'function' AND NOT is_definition").select("project_id", "filename", "line", "symbol").distinct()
    return G.resolve_calls(calls, t.entity)


# ---------------------------------------------------------------- extraction from files (no SQL can express a parser)


def _small_batches(t: Tables) -> DataFrame:
    bounded_batches(t._spark)
    return t.sourcecode


@_q("extract_entities")
def _(t: Tables) -> DataFrame:
    return extraction.extract(_small_batches(t), kinds=("function", "class", "struct", "interface"))


@_q("extract_inheritance")
def _(t: Tables) -> DataFrame:
    return extraction.extract(_small_batches(t), kinds=("extends", "implements", "embeds"))


@_q("extract_calls")
def _(t: Tables) -> DataFrame:
    return extraction.extract(_small_batches(t), kinds=("call",))


@_q("extract_identifiers")
def _(t: Tables) -> DataFrame:
    return extraction.extract(_small_batches(t), kinds=("identifier",))


@_q("control_flow_nodes")
def _(t: Tables) -> DataFrame:
    return flow.control_flow(_small_batches(t))[0]


@_q("control_flow_edges")
def _(t: Tables) -> DataFrame:
    return flow.control_flow(_small_batches(t))[1]


@_q("assemble_entities")
def _(t: Tables) -> DataFrame:
    return extraction.assemble_entities(_small_batches(t))


@_q("calls_with_comments")
def _(t: Tables) -> DataFrame:
    """Calls in files with the comment that ends on the line above."""
    found = cut(extraction.extract(_small_batches(t), kinds=("call", "block")))
    calls = found.filter("kind = 'call'").selectExpr("file_id", "symbol", "start_line AS line", "detail AS callee")
    return catalog.attach_comments(calls, found.filter("kind = 'block'").selectExpr("file_id", "start_line", "end_line", "detail AS text"))
