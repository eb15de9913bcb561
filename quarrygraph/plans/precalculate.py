"""The analyses of all projects calculated ahead, in order: complexity, duplication, dashboard, files. Each part is one
distributed plan over all projects, whose rows replace those of the part in the stored cache; a part that fails
is noted, keeps its old rows, and does not stop the next."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codegraph as G
from ..operators import reports as P
from .rounds import cut


def _as_json(df: DataFrame, item: str | None = None) -> DataFrame:
    """(project_id, item, data) with the other columns as JSON."""
    rest = [c for c in df.columns if c not in ("project_id", item)]
    return df.select("project_id", (F.col(item) if item else F.lit(None).cast("string")).alias("item"), F.to_json(F.struct(*rest)).alias("data"))


def parts(entity: DataFrame, relationship: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """The plans by analysis type, in their order."""

    def complexity() -> DataFrame:
        return _as_json(G.code_metrics(G.function_complexity(entity)))

    def duplication() -> DataFrame:
        return _as_json(P.duplication_share(cut(G.duplicate_pairs(entity).select("id_a", "id_b")), entity))

    def dashboard() -> DataFrame:
        return P.cached_dashboard(entity, relationship).select("project_id", F.lit(None).cast("string").alias("item"), "data")

    def files() -> DataFrame:
        return _as_json(P.file_analytics(G.function_complexity(entity), entity)[0], "filename")

    return {"complexity": complexity, "duplication": duplication, "dashboard": dashboard, "files": files}


def precalculate(spark: SparkSession, plans: dict[str, Callable[[], DataFrame]], path: str) -> list[tuple[str, float, str | None]]:
    """Writes each plan's rows to its partition (analysis_type) of the cache at ``path``; gives (part, seconds, error)."""
    done = []
    for name, plan in plans.items():
        began, error = time.perf_counter(), None
        try:
            rows = plan().withColumn("updated_at", F.current_timestamp()).withColumn("analysis_type", F.lit(name))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_type").parquet(path)
        except Exception as e:  # noqa: BLE001, a failing part must not stop the others
            error = f"{type(e).__name__}: {e}"[:500]
        done.append((name, time.perf_counter() - began, error))
    return done


def read_cache(spark: SparkSession, path: str, analysis_type: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("analysis_type") == analysis_type)
