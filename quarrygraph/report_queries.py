"""More queries of the code graph, registered beside those of ``queries``: reports, hierarchies, places, and changes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import rules as R
from .functions import text as T
from .operators import catalog as C
from .operators import codegraph as G
from .operators import hierarchy
from .operators import reports as P
from .plans.rounds import cut
from .queries import _AS, _CONC, _EXTENDS_SQL, _M, _TF, SQL, Tables, _extends, _has, _q, _score, _sums

def _sql(name: str) -> str:
    return f"({SQL[name]})"


# ---------------------------------------------------------------- rules


def _rules(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


SQL["concurrency_warnings"] = f"""WITH g AS (SELECT id, project_id, count(*) FILTER (WHERE category IN ('async', 'thread')) AS a, count(*) FILTER (WHERE category = 'sync') AS s,
count(*) FILTER (WHERE category = 'sync' AND kind IN ('lock_acquire', 'rlock_acquire')) AS taken, count(*) FILTER (WHERE category = 'sync' AND kind IN ('lock_release', 'rlock_release')) AS given FROM ({_CONC}) GROUP BY ALL)
SELECT id, project_id, 'shared_state_no_lock' AS warning FROM g WHERE a > 0 AND s = 0 UNION ALL SELECT id, project_id, 'lock_not_released' FROM g WHERE taken > given"""


def _leak(lang: str, release: str) -> str:
    return f"NOT {_has('source', release)}" + (f" AND NOT {_has('source', R.RELEASED_BY_FORM[lang])}" if lang in R.RELEASED_BY_FORM else "")


_OF = "FROM entity WHERE type = 'function' AND source IS NOT NULL AND language ="
SQL["resource_findings"] = _rules([f"SELECT id, project_id, '{k}' AS kind, '{n}' AS resource, {_leak(lang, r)} AS leak {_OF} '{lang}' AND {_has('source', a)}" for lang, rows in R.RESOURCES.items() for k, n, a, r in rows])
_FORMS = {(n, lang): "|".join(f"(?:{x})" for x in forms) for names in R.PATTERN_KINDS.values() for n in names for lang in R.PATTERN_LANGUAGES if (forms := R.pattern_forms(n, lang))}
_OTHERS = ", ".join(f"'{x}'" for x in R.PATTERN_LANGUAGES if x != "javascript")
SQL["design_patterns"] = _rules([
    f"SELECT id, project_id, '{n}' AS pattern, '{c}' AS category FROM entity WHERE source IS NOT NULL AND " + (f"lower(language) NOT IN ({_OTHERS})" if lang == "javascript" else f"lower(language) = '{lang}'") + f" AND {_has('source', _FORMS[n, lang])}"
    for c, names in R.PATTERN_KINDS.items() for n in names for lang in R.PATTERN_LANGUAGES if (n, lang) in _FORMS
])


@_q("resource_warnings", _rules([f"SELECT id, project_id, '{w}' AS warning, '{sev}' AS severity {_OF} '{lang}' AND {_has('source', a)} AND NOT {_has('source', b)}" for lang, (w, sev, a, b) in R.RESOURCE_WARNINGS.items()]))
def _(t: Tables) -> DataFrame:
    return G.resource_warnings(t.entity)


@_q("resource_holders", _rules(
    [f"SELECT id, project_id, 'release' AS finding, '{k}' AS kind, '{n}' AS resource {_OF} '{lang}' AND {_has('source', r)}" for lang, rows in R.RESOURCES.items() for k, n, a, r in rows]
    + [f"SELECT id, project_id, 'safe', '{k}', '{n}' {_OF} '{lang}' AND {_has('source', p)}" for lang, rows in R.SAFE_RESOURCES.items() for k, n, p in rows]
))
def _(t: Tables) -> DataFrame:
    return G.resource_holders(t.entity)


def _rollup(name: str, by: str) -> str:
    return f"SELECT x.project_id, {by}, count(*) AS findings, count(DISTINCT x.id) AS functions, count(DISTINCT e.filename) AS files FROM {_sql(name)} x JOIN entity e ON e.id = x.id GROUP BY ALL"


@_q("concurrency_by_language", _rollup("concurrency_findings", "e.language, x.category"))
def _(t: Tables) -> DataFrame:
    return P.findings_by(G.concurrency_findings(t.entity), t.entity, ["language", "category"])


@_q("resources_by_category", _rollup("resource_findings", "e.language, x.kind"))
def _(t: Tables) -> DataFrame:
    return P.findings_by(G.resource_findings(t.entity), t.entity, ["language", "kind"])


@_q("patterns_by_category", _rollup("design_patterns", "x.category, x.pattern"))
def _(t: Tables) -> DataFrame:
    return P.findings_by(G.design_patterns(t.entity), t.entity, ["category", "pattern"])


def _places(name: str, kind: str, limit: int) -> str:
    cols = ", ".join(f"x.{k}" for k in kind.split(", "))
    return f"""SELECT project_id, {kind}, total, total > {limit} AS truncated, rank, id, symbol, filename, start_line FROM (SELECT x.project_id, {cols}, x.id, e.symbol, e.filename, e.start_line,
    count(*) OVER (PARTITION BY x.project_id, {cols}) AS total, row_number() OVER (PARTITION BY x.project_id, {cols} ORDER BY e.filename NULLS FIRST, e.start_line NULLS FIRST, x.id) AS rank FROM {_sql(name)} x JOIN entity e ON e.id = x.id) WHERE rank <= {limit}"""


@_q("concurrency_places", _places("concurrency_findings", "category, kind", 20))
def _(t: Tables) -> DataFrame:
    return P.finding_places(G.concurrency_findings(t.entity), t.entity, ["category", "kind"])


@_q("pattern_places", _places("design_patterns", "pattern", 100))
def _(t: Tables) -> DataFrame:
    return P.finding_places(G.design_patterns(t.entity), t.entity, ["pattern"], 100)


@_q("security_places", _places("security_findings", "rule", 20))
def _(t: Tables) -> DataFrame:
    return P.finding_places(G.security_findings(t.entity).drop("filename"), t.entity, ["rule"])


def _share(name: str) -> str:
    return f"SELECT n.project_id, n.functions, coalesce(g.w, 0) AS with_findings, coalesce(g.f, 0) AS findings, floor(coalesce(g.w, 0) / n.functions * 100 * 10 + 0.5) / 10.0::DOUBLE AS percentage FROM (SELECT project_id, count(*) AS functions FROM entity WHERE type = 'function' GROUP BY 1) n LEFT JOIN (SELECT project_id, count(DISTINCT id) AS w, count(*) AS f FROM {_sql(name)} GROUP BY 1) g ON g.project_id = n.project_id"


@_q("concurrency_summary", _share("concurrency_findings"))
def _(t: Tables) -> DataFrame:
    return P.share_of_functions(G.concurrency_findings(t.entity), t.entity)


@_q("resource_summary", _share("resource_findings"))
def _(t: Tables) -> DataFrame:
    return P.share_of_functions(G.resource_findings(t.entity), t.entity)


# ---------------------------------------------------------------- metrics and lists


def _top(table: str, by: str, value: str, order: str, limit: int) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank, count(*) OVER (PARTITION BY {by}) > {limit} AS truncated FROM {table}"


@_q("top_functions", f"WITH {_M} " + " UNION ALL ".join(f"SELECT project_id, '{n}' AS list, rank, id, symbol, {c}::BIGINT AS value, truncated FROM ({_top('mr', 'project_id', c, f'{c} DESC, id', 20)}) WHERE rank <= 20" for n, c in (("complexity", "cyclomatic"), ("size", "loc"))))
def _(t: Tables) -> DataFrame:
    return P.top_functions(G.function_complexity(t.entity))


_W = R.READABILITY_WEIGHTS
_PLAIN = ", ".join(f"{x!r}::DOUBLE" for x in R.PLAIN_NUMBERS)
# a number stands free of letters, digits and points, so it is a whole run of such characters
SQL["readability_score"] = f"""WITH b AS (SELECT e.id, e.project_id, r.identifier_score, r.boolean_score, r.length_score, string_split(e.source, chr(10)) AS lines,
    CASE WHEN e.language IN ('python', 'ruby') THEN '^\\s*#' WHEN e.language IN ('javascript', 'typescript', 'java', 'go', 'rust', 'c', 'cpp') THEN '^\\s*//' ELSE '^\\s*(//|#)' END AS mark FROM entity e JOIN {_sql('readability')} r ON r.id = e.id),
c AS (SELECT *, list_filter(lines, lambda x: trim(x) <> '') AS filled, list_filter(list_transform(lines, lambda x: len(x)), lambda n: n > 0) AS lengths,
    list_filter(lines, lambda x: NOT regexp_matches(x, '^\\s*(//|#|/\\*)') AND NOT regexp_matches(x, '(?i)\\b(const|final|static|#define)\\b') AND NOT regexp_matches(x, '\\[\\s*\\d+\\s*\\]')) AS plain FROM b),
d AS (SELECT *, CASE WHEN len(filled) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(filled, lambda x: regexp_matches(x, mark))) / len(filled)::DOUBLE END AS ratio,
    list_reduce(list_concat([0::BIGINT], list_transform(lines, lambda x: len(regexp_extract_all(x, '[{{\\[(]')) * 100000 + len(regexp_extract_all(x, '[}}\\])]')))), lambda a, x: greatest(a // 100000, a % 100000 + x // 100000) * 100000 + greatest(a % 100000 + x // 100000 - x % 100000, 0)) // 100000 AS deepest,
    len(list_filter(lengths, lambda n: n > 120)) / len(lengths)::DOUBLE * 100 AS over, coalesce(list_max(lengths), 0) AS longest,
    len(list_filter(flatten(list_transform(plain, lambda x: list_filter(regexp_extract_all(x, '[\\w.]+'), lambda w: regexp_full_match(w, '\\d+(\\.\\d+)?')))), lambda w: w::DOUBLE NOT IN ({_PLAIN}))) AS magic FROM c),
f AS (SELECT id, project_id, identifier_score, boolean_score, length_score,
    floor((CASE WHEN ratio >= 0.2::DOUBLE THEN 100.0 WHEN ratio >= 0.1::DOUBLE THEN 85.0 WHEN ratio >= 0.05::DOUBLE THEN 70.0 WHEN ratio >= 0.02::DOUBLE THEN 50.0 ELSE greatest(0.0::DOUBLE, 50.0::DOUBLE - (0.02::DOUBLE - ratio) * 10) END)::DOUBLE + 0.5::DOUBLE)::BIGINT AS comment_score,
    floor({_score('deepest', 2, 3, 4, 6)} + 0.5::DOUBLE)::BIGINT AS nesting_score,
    CASE WHEN len(lengths) = 0 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, floor({_score('longest', 80, 100, 120, 150)} - least(30.0::DOUBLE, over) + 0.5::DOUBLE)) END AS line_score,
    floor({_score('magic', 0, 2, 5, 10)} + 0.5::DOUBLE)::BIGINT AS number_score FROM d),
g AS (SELECT *, floor((identifier_score * {_W['identifiers']}::DOUBLE + comment_score * {_W['comments']}::DOUBLE + nesting_score * {_W['nesting']}::DOUBLE + line_score * {_W['lines']}::DOUBLE + number_score * {_W['numbers']}::DOUBLE + boolean_score * {_W['booleans']}::DOUBLE) / {1 - R.READABILITY_LENGTH}::DOUBLE + 0.5::DOUBLE)::BIGINT AS score FROM f)
SELECT *, floor(score * {1 - R.READABILITY_LENGTH}::DOUBLE + floor(length_score + 0.5::DOUBLE) * {R.READABILITY_LENGTH}::DOUBLE + 0.5::DOUBLE)::BIGINT AS combined_score,
CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 55 THEN 'acceptable' WHEN score >= 40 THEN 'poor' ELSE 'very_poor' END AS rating FROM g"""
_EXTREMES = " UNION ALL ".join(f"SELECT project_id, '{n}' AS list, rank, id, score FROM (SELECT project_id, id, combined_score AS score, row_number() OVER (PARTITION BY project_id ORDER BY combined_score {o}, id) AS rank FROM {_sql('readability_score')}) WHERE rank <= 10" for n, o in (("worst", "ASC"), ("best", "DESC")))
_RATED = {"excellent": "combined_score >= 85", "good": "combined_score BETWEEN 70 AND 84", "acceptable": "combined_score BETWEEN 55 AND 69", "poor": "combined_score BETWEEN 40 AND 54", "very_poor": "combined_score < 40"}


@_q("readability_extremes", _EXTREMES)
def _(t: Tables) -> DataFrame:
    return P.readability_extremes(G.readability_score(t.entity))


@_q("readability_by_project", f"SELECT project_id, count(*) AS functions, floor(avg(combined_score) + 0.5)::BIGINT AS average, {', '.join(f'count(*) FILTER (WHERE {v}) AS {k}' for k, v in _RATED.items())} FROM {_sql('readability_score')} GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return P.readability_by_project(G.readability_score(t.entity))


_COUNT = "(SELECT project_id, count(*) AS functions FROM entity WHERE type = 'function' GROUP BY 1)"


@_q("smell_density", f"SELECT n.project_id, n.functions, coalesce(g.smells, 0) AS smells, coalesce(g.high, 0) AS high, coalesce(g.medium, 0) AS medium, floor(coalesce(g.smells, 0) / n.functions * 100 * 10 + 0.5) / 10.0::DOUBLE AS density FROM {_COUNT} n LEFT JOIN (SELECT project_id, count(*) AS smells, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium FROM {_sql('code_smells')} GROUP BY 1) g ON g.project_id = n.project_id")
def _(t: Tables) -> DataFrame:
    return P.smell_density(G.code_smells(G.function_complexity(t.entity)), t.entity)


@_q("duplication_share", f"WITH p AS (SELECT * FROM {_sql('duplicate_pairs')}), u AS (SELECT id_a AS id, 1 AS first FROM p UNION ALL SELECT id_b, 0 FROM p), g AS (SELECT e.project_id, sum(first)::BIGINT AS pairs, count(DISTINCT u.id) AS duplicated FROM u JOIN entity e ON e.id = u.id GROUP BY 1) SELECT n.project_id, n.functions, coalesce(g.pairs, 0)::BIGINT AS pairs, coalesce(g.duplicated, 0) AS duplicated, floor(coalesce(g.duplicated, 0) / n.functions * 100 * 10 + 0.5) / 10.0::DOUBLE AS percentage FROM {_COUNT} n LEFT JOIN g ON g.project_id = n.project_id")
def _(t: Tables) -> DataFrame:
    return P.duplication_share(cut(G.duplicate_pairs(t.entity).select("id_a", "id_b")), t.entity)


@_q("api_summary", f"SELECT project_id, count(*) FILTER (WHERE NOT is_private) AS public, count(*) FILTER (WHERE is_private) AS private, count(*) FILTER (WHERE entry_point) AS entry_points, count(*) FILTER (WHERE NOT is_private AND NOT documented) AS undocumented, floor(count(*) FILTER (WHERE NOT is_private AND documented) / nullif(count(*) FILTER (WHERE NOT is_private), 0) * 100 * 10 + 0.5) / 10.0::DOUBLE AS documented_pct, floor(avg(params) FILTER (WHERE NOT is_private) * 10 + 0.5) / 10.0::DOUBLE AS avg_params FROM {_sql('api_surface')} GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return P.api_summary(G.api_surface(t.entity, t.relationship))


@_q("scope_summary", f"SELECT project_id, issue, count(*) AS functions, sum(n)::BIGINT AS occurrences FROM {_sql('scope_issues')} GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return P.scope_summary(G.scope_issues(t.entity))


_AVG = "floor(avg({0}) * 100 + 0.5) / 100.0::DOUBLE"


@_q("file_analytics", f"WITH {_M}, k AS (SELECT project_id, filename, count(*) FILTER (WHERE type = 'function') AS function_count, count(*) FILTER (WHERE type = 'class') AS class_count, count(*) FILTER (WHERE type = 'struct') AS struct_count FROM entity GROUP BY ALL), g AS (SELECT project_id, filename, {_AVG.format('cyclomatic')} AS avg_cyclomatic, min(cyclomatic) AS min_cyclomatic, max(cyclomatic) AS max_cyclomatic, {_AVG.format('loc')} AS avg_loc, min(loc) AS min_loc, max(loc) AS max_loc, {_AVG.format('params')} AS avg_params, max(nesting) AS max_nesting FROM mr GROUP BY ALL) SELECT k.*, g.* EXCLUDE (project_id, filename), printf('%.2f', avg_cyclomatic) AS avg_text FROM k JOIN g ON g.project_id = k.project_id AND g.filename = k.filename")
def _(t: Tables) -> DataFrame:
    return P.file_analytics(G.function_complexity(t.entity), t.entity)[0]


@_q("file_top_functions", f"WITH {_M} SELECT project_id, filename, rank, id, symbol, cyclomatic, truncated FROM ({_top('(SELECT * FROM mr WHERE project_id IS NOT NULL AND filename IS NOT NULL)', 'project_id, filename', 'cyclomatic', 'cyclomatic DESC, id', 5)}) WHERE rank <= 5")
def _(t: Tables) -> DataFrame:
    return P.file_analytics(G.function_complexity(t.entity), t.entity)[1]


@_q("light_counts", "SELECT project_id, count(*) FILTER (WHERE type = 'function') AS functions, count(*) FILTER (WHERE type IN ('class', 'struct')) AS classes, count(DISTINCT filename) AS files, count(DISTINCT language) AS languages, count(*) FILTER (WHERE type = 'function' AND comment <> '') AS commented, count(DISTINCT filename) FILTER (WHERE filename ILIKE '%test%' OR filename ILIKE '%spec%') AS test_files FROM entity GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return P.light_counts(t.entity)


_PARTS = {
    "functions": _COUNT.replace("AS functions", "AS n"), "dead": f"(SELECT project_id, count(*) AS n FROM {_sql('dead_code')} WHERE NOT entry_point GROUP BY 1)", "smells": f"(SELECT project_id, count(*) AS n FROM {_sql('code_smells')} GROUP BY 1)",
    "security": f"(SELECT project_id, count(*) AS n FROM {_sql('security_findings')} GROUP BY 1)", "typed": f"(SELECT project_id, count(*) FILTER (WHERE has_hint) AS n FROM {_sql('type_inference')} GROUP BY 1)", "public": f"(SELECT project_id, count(*) FILTER (WHERE NOT is_private) AS n FROM {_sql('api_surface')} GROUP BY 1)",
    "documented": f"(SELECT project_id, count(*) FILTER (WHERE has_comment) AS n FROM {_sql('doc_status')} GROUP BY 1)", "scope": f"(SELECT project_id, count(*) AS n FROM {_sql('scope_issues')} GROUP BY 1)", "misnamed": f"(SELECT project_id, count(*) FILTER (WHERE NOT compliant) AS n FROM {_sql('naming_compliance')} GROUP BY 1)",
}
_DATA = " || ',' || ".join(f"'\"{k}\":' || coalesce({k}.n, 0)" for k in _PARTS)


@_q("cached_dashboard", f"SELECT functions.project_id, 'dashboard' AS analysis_type, '{{' || {_DATA} || '}}' AS data FROM {_PARTS['functions']} functions " + " ".join(f"LEFT JOIN {v} {k} ON {k}.project_id = functions.project_id" for k, v in _PARTS.items() if k != "functions"))
def _(t: Tables) -> DataFrame:
    return P.cached_dashboard(t.entity, t.relationship)


_TESTS = "CASE " + " ".join(f"WHEN language = '{k}' THEN ({' OR '.join(_has('source', p) for p in v)})" for k, v in R.TEST_FUNCTIONS.items()) + f" ELSE ({' OR '.join(_has('source', p) for p in R.TEST_FUNCTIONS['javascript'])}) END"
_NAMED = "CASE " + " ".join(f"WHEN language = '{k}' THEN {_has('symbol', p)}" for k, p in R.TEST_NAMES.items()) + " ELSE true END"


@_q("test_quality", f"""SELECT project_id, count(*) AS tests, sum(asserts)::BIGINT AS assertions, sum(mocks)::BIGINT AS mocks, count(*) FILTER (WHERE asserts = 0) AS without_assertion, count(*) FILTER (WHERE len(symbol) < 10) AS short_names, count(*) FILTER (WHERE regexp_matches(symbol, '^test\\d+$')) AS numbered_names,
count(*) FILTER (WHERE symbol = 'test') AS bare_names, count(*) FILTER (WHERE NOT named) AS odd_names, floor(sum(asserts) / count(*) * 100 + 0.5) / 100.0::DOUBLE AS assertions_per_test
FROM (SELECT project_id, symbol, {_AS} AS asserts, {_sums(R.MOCKS)} AS mocks, {_NAMED} AS named FROM (SELECT * REPLACE (coalesce(source, '') AS source) FROM entity) WHERE type = 'function' AND filename IS NOT NULL AND {_TF} AND {_TESTS}) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return G.test_quality(t.entity)


def _truncated(name: str, order: str, limit: int) -> str:
    return f"SELECT * EXCLUDE (n), n > {limit} AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY project_id) AS n, row_number() OVER (PARTITION BY project_id ORDER BY {order}) AS rank FROM {_sql(name)}) WHERE rank <= {limit}"


@_q("naming_issue_list", _truncated("naming_word_issues", "id, issue", 100))
def _(t: Tables) -> DataFrame:
    return P.top_rows(G.naming_word_issues(t.entity), ["project_id"], [F.col("id"), F.col("issue")], 100).drop("total")


# ---------------------------------------------------------------- places and names


@_q("entity_search_escaped", SQL["entity_search"].replace("'load%'", "'l\\_d%' ESCAPE '\\'").replace("%load%", "%l_d%").replace("load", "l_d"))
def _(t: Tables) -> DataFrame:
    return G.entity_search(t.entity, "l_d")


@_q("symbols_at_location", """WITH p AS (SELECT project_id, filename, min(line) AS line, 8 AS col FROM symbol_reference WHERE project_id IS NOT NULL AND filename IS NOT NULL GROUP BY ALL)
SELECT r.id, r.project_id, r.filename, r.line, p.col AS column_at, r.symbol, r.symbol_type, coalesce(r.column_start, 0) AS column_from, r.column_end, r.is_definition, r.is_write, e.filename AS definition_filename, e.start_line AS definition_line, e.parameters, e.return_type, e.comment
FROM p JOIN symbol_reference r ON r.project_id = p.project_id AND r.filename = p.filename AND r.line = p.line LEFT JOIN entity e ON e.id = r.definition_entity_id WHERE p.col BETWEEN coalesce(r.column_start, 0) AND r.column_end""")
def _(t: Tables) -> DataFrame:
    places = t.symbol_reference.filter("project_id IS NOT NULL AND filename IS NOT NULL").groupBy("project_id", "filename").agg(F.min("line").alias("line")).withColumn("column", F.lit(8))
    return G.symbols_at_location(t.symbol_reference, t.entity, places)


@_q("minhash_signatures", f"""WITH t AS (SELECT id, list_transform(list_distinct(list_filter(regexp_split_to_array(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(source, '(?m)//.*$', '', 'g'), '/\\*[\\s\\S]*?\\*/', '', 'g'), '(?m)#.*$', '', 'g'), '\\s+', ' ', 'g'))), '\\s+'), lambda x: len(x) > 2)), lambda w: struct_pack(h := list_reduce(list_concat([0::BIGINT], list_transform(string_split(w, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296), p := list_reduce(list_concat([1::BIGINT], list_transform(string_split(w, ''), lambda c: 31::BIGINT)), lambda h, c: (h * c) % 4294967296))) AS ws FROM entity WHERE type = 'function' AND source IS NOT NULL)
SELECT id, array_to_string(list_transform(range(0, 64), lambda i: list_min(list_transform(ws, lambda w: (i * 31337 * w.p + w.h) % 4294967296))), ' ') AS signature FROM t WHERE len(ws) > 0""")
def _(t: Tables) -> DataFrame:
    f = G.functions_of(t.entity).filter("source IS NOT NULL").select("id", T.tokens(F.col("source")).alias("tokens")).filter(F.size("tokens") > 0)
    return f.select("id", F.array_join(F.transform(T.minhash_signature(F.col("tokens")), lambda x: x.cast("string")), " ").alias("signature"))


@_q("entity_search_named", f"SELECT x.*, e.project_id, p.name AS project_name FROM {_sql('entity_search')} x JOIN entity e ON e.id = x.id LEFT JOIN project p ON p.id = e.project_id")
def _(t: Tables) -> DataFrame:
    return G.entity_search_named(t.entity, t.project, "load")


@_q("enclosing_functions", """WITH p AS (SELECT DISTINCT project_id, filename, line FROM symbol_reference), k AS (SELECT p.*, e.id AS function_id, e.symbol AS function, row_number() OVER (PARTITION BY p.project_id, p.filename, p.line ORDER BY e.end_line - e.start_line, e.id) AS r
FROM p JOIN entity e ON e.project_id = p.project_id AND e.filename = p.filename AND p.line BETWEEN e.start_line AND e.end_line WHERE e.type = 'function') SELECT * EXCLUDE (r) FROM k WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    return G.enclosing_functions(t.symbol_reference, t.entity)


# ---------------------------------------------------------------- classes


@_q("class_descendants", SQL["p6_descendants"].replace("cur AS node_id, node AS descendant_id, d AS distance", "cur AS class_id, node AS descendant_id, d AS distance"))
def _(t: Tables) -> DataFrame:
    return hierarchy.descendants(hierarchy.forest(_extends(t._spark, t._base))).select(F.col("node_id").alias("class_id"), "descendant_id", "distance")


_LINKS = "l AS (SELECT DISTINCT child_entity_id AS child, parent_entity_id AS parent, lower(trim(relationship_type)) AS kind FROM inheritance WHERE child_entity_id IS NOT NULL AND parent_entity_id IS NOT NULL)"


def _tree(a: str, b: str, name: str) -> str:
    return f"SELECT root_id, '{name}' AS direction, depth, class_id, min(kind) AS relationship_type FROM (SELECT w.root AS root_id, w.node AS class_id, w.d AS depth, l.kind FROM w_{name} w JOIN w_{name} v ON v.root = w.root AND v.d = w.d - 1 JOIN l ON l.{a} = v.node AND l.{b} = w.node WHERE w.d = (SELECT min(d) FROM w_{name} x WHERE x.root = w.root AND x.node = w.node) AND w.d > 0 AND v.d = (SELECT min(d) FROM w_{name} x WHERE x.root = v.root AND x.node = v.node)) GROUP BY ALL"


@_q("class_tree", f"WITH RECURSIVE {_LINKS}, r AS (SELECT parent AS root FROM l GROUP BY parent ORDER BY count(DISTINCT child) DESC, parent LIMIT 3), " + ", ".join(f"w_{n} AS (SELECT root, root AS node, 0 AS d FROM r UNION SELECT w.root, l.{b}, w.d + 1 FROM w_{n} w JOIN l ON l.{a} = w.node WHERE w.d < 10)" for n, a, b in (("up", "child", "parent"), ("down", "parent", "child"))) + " " + _tree("child", "parent", "up") + " UNION ALL " + _tree("parent", "child", "down"))
def _(t: Tables) -> DataFrame:
    e = t.inheritance.filter("child_entity_id IS NOT NULL AND parent_entity_id IS NOT NULL")
    roots = e.groupBy(F.col("parent_entity_id").alias("node")).agg(F.countDistinct("child_entity_id").alias("n")).orderBy(F.col("n").desc(), "node").limit(3).select("node")
    return P.class_tree(t.inheritance, cut(roots))


@_q("hierarchy_summary", SQL["p6_found"].split("calls AS (")[0].rstrip().rstrip(",") + """, c AS (SELECT id, project_id, coalesce(is_abstract, false) AS abstract FROM entity WHERE type IN ('class', 'struct')),
m AS (SELECT c.*, coalesce(tr.depth, 0) AS depth, c.id NOT IN (SELECT child_entity_id FROM inheritance WHERE child_entity_id IS NOT NULL) AS root, c.id NOT IN (SELECT parent_entity_id FROM inheritance WHERE parent_entity_id IS NOT NULL) AS leaf FROM c LEFT JOIN (SELECT * FROM trees WHERE depth >= 0) tr ON tr.node_id = c.id),
g AS (SELECT project_id, count(*) AS classes, count(*) FILTER (WHERE root) AS roots, count(*) FILTER (WHERE leaf) AS leaves, count(*) FILTER (WHERE abstract) AS abstract_classes, max(depth) AS max_depth FROM m GROUP BY 1),
k AS (SELECT c.project_id, count(*) AS relations, count(*) FILTER (WHERE lower(trim(relationship_type)) = 'extends') AS extends_count, count(*) FILTER (WHERE lower(trim(relationship_type)) = 'implements') AS implements_count, count(*) FILTER (WHERE lower(trim(relationship_type)) = 'embeds') AS embeds_count FROM inheritance i JOIN c ON c.id = i.child_entity_id GROUP BY 1)
SELECT g.*, coalesce(k.relations, 0) AS relations, coalesce(k.extends_count, 0) AS extends_count, coalesce(k.implements_count, 0) AS implements_count, coalesce(k.embeds_count, 0) AS embeds_count, floor(coalesce(k.relations, 0) / g.classes * 10 + 0.5) / 10.0::DOUBLE AS children_per_class, CASE WHEN g.max_depth > 0 THEN (SELECT min(id) FROM m WHERE m.project_id = g.project_id AND m.depth = g.max_depth) END AS deepest_class FROM g LEFT JOIN k ON k.project_id = g.project_id""")
def _(t: Tables) -> DataFrame:
    return P.hierarchy_summary(t.entity, t.inheritance, hierarchy.forest(_extends(t._spark, t._base), paths=False))


SQL["p6_paths"] = f"""WITH RECURSIVE {_EXTENDS_SQL},
nodes AS (SELECT child AS id FROM ext UNION SELECT parent FROM ext),
up AS (SELECT id AS node, id AS cur, 0 AS depth, [id] AS seen FROM nodes
    UNION ALL SELECT up.node, ext.parent, up.depth + 1, list_append(up.seen, ext.parent) FROM up JOIN ext ON ext.child = up.cur WHERE NOT list_contains(up.seen, ext.parent)),
tip AS (SELECT node, arg_max(cur, depth) AS last, max(depth) AS depth, arg_max(seen, depth) AS seen FROM up GROUP BY node),
ok AS (SELECT node FROM tip WHERE last NOT IN (SELECT child FROM ext)),
below AS (SELECT cur AS node, count(*) AS size, max(depth) AS peel FROM up WHERE node IN (FROM ok) GROUP BY cur)
SELECT tip.node AS node_id, own.parent AS parent_id, CASE WHEN ok.node IS NOT NULL THEN tip.last ELSE list_min(tip.seen[list_position(tip.seen, e.parent):]) END AS root_id, CASE WHEN ok.node IS NOT NULL THEN tip.depth ELSE -1 END AS depth,
CASE WHEN ok.node IS NOT NULL THEN below.size END AS subtree_size, CASE WHEN ok.node IS NOT NULL THEN below.peel END AS peel_level, CASE WHEN ok.node IS NOT NULL THEN array_to_string(list_reverse(tip.seen), '>') END AS path
FROM tip LEFT JOIN ext own ON own.child = tip.node LEFT JOIN ext e ON e.child = tip.last LEFT JOIN ok ON ok.node = tip.node LEFT JOIN below ON below.node = tip.node"""


# ---------------------------------------------------------------- changes of tables


@_q("project_upsert", "SELECT name, min(path) AS path, max(git_url) AS git_url FROM project GROUP BY name")
def _(t: Tables) -> DataFrame:
    # each project is put in again: by its least row into an empty table, then by all of its rows
    p = t.project.select("name", "path", "git_url")
    empty = t.project.select("name", "path", "git_url", "created_at", "updated_at").limit(0)
    first = C.project_upsert(empty, p.groupBy("name").agg(F.min("path").alias("path"), F.lit(None).cast("string").alias("git_url")))
    return C.project_upsert(first, p.groupBy("name").agg(F.max("path").alias("path"), F.max("git_url").alias("git_url"))).select("name", "path", "git_url")


@_q("inheritance_update", """WITH g AS (SELECT child_entity_id AS id, arg_min(parent_symbol, id) FILTER (WHERE lower(trim(relationship_type)) = 'extends' AND parent_symbol IS NOT NULL) AS parent, list_sort(list(DISTINCT parent_symbol) FILTER (WHERE lower(trim(relationship_type)) = 'implements' AND parent_symbol IS NOT NULL)) AS impl FROM inheritance WHERE child_entity_id IS NOT NULL GROUP BY 1)
SELECT e.id, coalesce(g.parent, e.parent_class) AS parent_class, array_to_string(CASE WHEN len(g.impl) > 0 THEN g.impl ELSE e.interfaces END, ',') AS interfaces, e.is_abstract FROM entity e LEFT JOIN g ON g.id = e.id WHERE e.type IN ('class', 'struct')""")
def _(t: Tables) -> DataFrame:
    return C.inheritance_update(t.entity, t.inheritance).withColumn("interfaces", F.array_join("interfaces", ","))


@_q("code_and_other", "SELECT lower(regexp_extract(filename, '\\.([^./]*)$', 1)) AS extension, coalesce(lower(regexp_extract(filename, '\\.([^./]*)$', 1)) IN ('c', 'h', 'cpp', 'py', 'js', 'ts', 'java', 'go', 'rs', 'cs', 'mjs', 'cc', 'hpp'), false) AS is_code, count(*) AS files FROM sourcecode GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    ext = F.lower(F.regexp_extract("filename", r"\.([^./]*)$", 1))
    return C.code_and_other(t.sourcecode.select("filename"), ("c", "h", "cpp", "py", "js", "ts", "java", "go", "rs", "cs", "mjs", "cc", "hpp")).groupBy(ext.alias("extension"), "is_code").agg(F.count("*").alias("files"))
