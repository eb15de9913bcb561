"""Problem 9: sources mixed to target weights.

The size of a source is the number of its tokens. Capped water-filling gives each source of a mix its
share of the wanted size: sources that would need more than ``max_repeats`` repetitions are clamped there,
and what they can't give goes to the others in proportion to their shares, until nobody is over its cap.
A source's amount is some whole repetitions of all its texts and a fraction of one; the fraction is taken
in the order of a seeded hash. Its edge is found in two steps, so that no source is ever sorted in one
task: token sums of ``BINS`` hash ranges give the range it lies in, and only that range is ordered.

Cases: texts without tokens (null or empty) belong to no mix; a null source is no source; sources that a
mix names but the documents lack give nothing, and their share goes to the others; a mix that wants more
than its sources may give gets all they may give; shares that don't add up to 1 are scaled; repeated texts
under other ids are texts of their own; ids must be unique; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rounds import cut, stored

SEED = 11
BINS = 4096


def water_fill(wanted: float, shares: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """The amount of each source: proportional to its share, none over its cap, together ``wanted`` if the caps allow it."""
    given = {s: 0.0 for s in shares}
    open_ = {s for s in shares if caps.get(s, 0) > 0 and shares[s] > 0}
    left = min(wanted, sum(caps[s] for s in open_))
    while open_ and left > 0:
        total = sum(shares[s] for s in open_)
        over = {s for s in open_ if left * shares[s] / total >= caps[s]}
        if not over:
            for s in open_:
                given[s] = left * shares[s] / total
            break
        for s in over:
            given[s] = caps[s]
            left -= caps[s]
        open_ -= over
    return given


def mix(sized: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, shares). rows: mix, doc_id, copies of every text used. shares: mix, source, target_share, max_repeats,
    available_tokens, wanted_tokens, actual_tokens, actual_share and the number of texts used.

    sized: doc_id, source, n_tokens. targets holds a row for each mix and source, and is planned on the driver
    together with one sum for each source it names, so both are bounded by its size."""
    spark = sized.sparkSession
    bin_ = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BINS))
    sized = stored(sized.select("doc_id", "source", "n_tokens"), "sizes")  # the tokens are counted once
    docs = sized.filter("source IS NOT NULL AND n_tokens > 0").select("doc_id", "source", "n_tokens", F.xxhash64("doc_id", F.lit(seed)).alias("h"), bin_.cast("int").alias("bin"))
    named = targets.select("source").distinct()
    sizes = {r[0]: r[1] for r in docs.join(F.broadcast(named), "source").groupBy("source").agg(F.sum("n_tokens")).collect()}
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    plan = []
    mixes: dict[str, list] = {}
    for r in targets.select("mix", "source", "target_share", "max_repeats", "size_factor").collect():
        mixes.setdefault(r["mix"], []).append(r)
    for name, rows in mixes.items():
        wanted = max(r["size_factor"] for r in rows) * total
        shares = {r["source"]: r["target_share"] for r in rows}
        caps = {r["source"]: float(r["max_repeats"] * sizes.get(r["source"], 0)) for r in rows}
        given = water_fill(wanted, shares, caps)
        for r in rows:
            have = sizes.get(r["source"], 0)
            whole = int(given[r["source"]] // have) if have else 0
            part = given[r["source"]] - whole * have
            plan.append((name, r["source"], float(r["target_share"]), int(r["max_repeats"]), int(have), float(given[r["source"]]), whole, float(part)))
    schema = "mix string, source string, target_share double, max_repeats int, available_tokens long, wanted_tokens double, whole int, part double"
    plans = spark.createDataFrame(plan, schema)
    # the hash range in which the fraction of each mix and source ends
    bins = docs.join(F.broadcast(named), "source").groupBy("source", "bin").agg(F.sum("n_tokens").alias("n"))
    before = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bin"))).withColumn("before", F.col("upto") - F.col("n"))
    edge = before.join(F.broadcast(plans.filter("part > 0")), "source").filter("before <= part AND part < upto").select("mix", "source", F.col("bin").alias("edge_bin"), (F.col("part") - F.col("before")).alias("rest"))
    edges = cut(plans.join(edge, ["mix", "source"], "left"))
    use = docs.join(F.broadcast(edges), "source")
    inside = use.filter("bin = edge_bin")
    run = F.sum("n_tokens").over(Window.partitionBy("mix", "source").orderBy("h", "doc_id"))
    # a text goes in while at least half of it fits into what is left
    inside = inside.withColumn("extra", F.when(run - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0))
    other = use.filter("edge_bin IS NULL OR bin <> edge_bin").withColumn("extra", F.when(F.col("bin") < F.col("edge_bin"), 1).otherwise(0))
    both = inside.select("mix", "source", "doc_id", "n_tokens", "whole", "extra").unionByName(other.select("mix", "source", "doc_id", "n_tokens", "whole", "extra"))
    rows = cut(both.withColumn("copies", F.col("whole") + F.col("extra")).filter("copies > 0").select("mix", "source", "doc_id", "n_tokens", "copies"))
    used = rows.groupBy("mix", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("texts"), F.max("copies").alias("most_repeats"))
    shares = plans.drop("whole", "part").join(used, ["mix", "source"], "left").fillna(0, ["actual_tokens", "texts", "most_repeats"])
    sums = shares.groupBy("mix").agg(F.sum("actual_tokens").alias("s"))
    shares = shares.join(sums, "mix").withColumn("actual_share", F.when(F.col("s") > 0, F.col("actual_tokens") / F.col("s")).otherwise(F.lit(0.0))).drop("s")
    return rows.select("mix", "doc_id", "copies"), shares
