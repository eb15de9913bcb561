"""Changes of the stored tables as sets: upserts of projects and of cached analyses, inheritance columns of classes, comments
of calls. Each gives the whole new table, which a job writes beside the old one and swaps in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project_upsert(old: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """name, path, git_url, created_at, updated_at after rows (name, path, git_url) are put in by name: a known name keeps path
    and creation, takes the new address unless it is null, and is marked as updated. Of several new rows of a name
    the last by path counts. Names of null are rows of their own."""
    now = F.current_timestamp() if now is None else now
    n = new.groupBy("name").agg(F.max_by(F.struct("path", "git_url"), "path").alias("x")).select("name", F.col("x.path").alias("new_path"), F.col("x.git_url").alias("new_url"), F.lit(True).alias("is_new"))
    both = old.select("name", "path", "git_url", "created_at", "updated_at").join(n, "name", "full_outer")
    added = F.col("created_at").isNull() & F.coalesce("is_new", F.lit(False))
    return both.select("name", F.coalesce("path", "new_path").alias("path"), F.coalesce("new_url", "git_url").alias("git_url"), F.when(added, now).otherwise(F.col("created_at")).alias("created_at"), F.when(F.coalesce("is_new", F.lit(False)) & ~added, now).otherwise(F.col("updated_at")).alias("updated_at"))


def inheritance_update(entity: DataFrame, inheritance: DataFrame) -> DataFrame:
    """id, parent_class, interfaces, is_abstract of every class after its inheritance rows are written into it: the parent of
    the row of the least id that extends, and the implemented names in order; without rows the columns stay."""
    i = inheritance.filter("child_entity_id IS NOT NULL").select("id", "child_entity_id", "parent_symbol", F.lower(F.trim("relationship_type")).alias("kind"))
    got = i.groupBy(F.col("child_entity_id").alias("id")).agg(
        F.min_by(F.when(F.col("kind") == "extends", F.col("parent_symbol")), F.when((F.col("kind") == "extends") & F.col("parent_symbol").isNotNull(), F.col("id"))).alias("new_parent"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "implements", F.col("parent_symbol")))).alias("new_interfaces"),
    )
    c = entity.filter(F.col("type").isin("class", "struct")).select("id", "parent_class", "interfaces", "is_abstract")
    some = F.size("new_interfaces") > 0
    return c.join(got, "id", "left").select("id", F.coalesce("new_parent", "parent_class").alias("parent_class"), F.when(some, F.col("new_interfaces")).otherwise(F.col("interfaces")).alias("interfaces"), "is_abstract")


def bulk_insert(table: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """The table with the rows appended under new ids above its own; ids have gaps, so no task has to count the others' rows."""
    last = table.agg(F.max(id_col)).first()[0] or 0
    fresh = rows.withColumn(id_col, (F.monotonically_increasing_id() + last + 1).cast(dict(table.dtypes)[id_col]))
    return table.unionByName(fresh, allowMissingColumns=True)


def analysis_upsert(cache: DataFrame, rows: DataFrame, now: Column | None = None) -> DataFrame:
    """The cache of (project_id, analysis_type, data, created_at, updated_at) with the rows (project_id, analysis_type, data) put in."""
    now = F.current_timestamp() if now is None else now
    key = ["project_id", "analysis_type"]
    n = rows.select(*key, F.col("data").alias("new_data")).dropDuplicates(key)
    both = cache.join(n, key, "full_outer")
    changed = F.col("new_data").isNotNull()
    return both.select(*key, F.coalesce("new_data", "data").alias("data"), F.coalesce("created_at", F.when(changed, now)).alias("created_at"), F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"))


def analysis_read(cache: DataFrame, analysis_type: str, schema: str) -> DataFrame:
    """project_id and the fields of the JSON text, also of one that was encoded twice."""
    text = F.when(F.col("data").startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), F.col("data"), F.lit("}")), "$.x")).otherwise(F.col("data"))
    return cache.filter(F.col("analysis_type") == analysis_type).select("project_id", F.from_json(text, schema).alias("x")).select("project_id", "x.*")


def attach_comments(calls: DataFrame, comments: DataFrame) -> DataFrame:
    """The calls (file_id, line, ...) with the text of the comment that ends on the line above; of several the last by begin.
    comments: file_id, start_line, end_line, text."""
    c = comments.groupBy("file_id", (F.col("end_line") + 1).alias("line")).agg(F.max_by("text", "start_line").alias("comment"))
    return calls.join(c, ["file_id", "line"], "left")


def code_and_other(sourcecode: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Every file with whether its extension is one of code."""
    ext = F.lower(F.regexp_extract("filename", r"\.([^./]*)$", 1))
    return sourcecode.withColumn("is_code", F.coalesce(ext.isin(*extensions), F.lit(False)))
