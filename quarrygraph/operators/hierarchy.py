"""Parent-child rows to full hierarchies, and the circles of a directed graph (problem 6).

``forest`` peels bottom-up: each node sends the size of its subtree and its peel level to the nodes above it, which
add up what they are told; in the reverse order, from the roots down, every node takes root, depth and path of the
node above it. Both go in strides that double (one step up, two, four, ...), so a chain of n nodes takes log n
rounds instead of n; what is never reached from a root lies on or below circles. Each round ends in a reliable
checkpoint. Descendants are given as rows, not as arrays, so the subtree of one root never has to fit into one task.

``circles`` peels off nodes without in- or out-edges, cuts the residual into weakly connected parts and finds the
strong components of each: parts of at most ``PART_EDGES`` edges by Tarjan's algorithm, one part a task,
larger ones by forward and backward colouring over the whole cluster.

Cases: null children or parents are no rows; repeated rows count once; of several parents of a child the
smallest is taken; a row that names itself as parent is a circle of one; nodes that hang below a circle
have depth -1, no path, size and peel level, and the circle's smallest node as root; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rounds import connected_components, cut

TWICE = 2  # rounds of colouring planned at once; each reads its predecessor twice
SHRINK = 0.85  # share of the edges that a round of peeling leaves, from which the rest is cut into parts
PART_EDGES = 100_000


def tree_rows(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(id, parent): one row a child, the smallest parent of several."""
    return edges.filter(F.col(child).isNotNull() & F.col(parent).isNotNull()).groupBy(F.col(child).alias("id")).agg(F.min(parent).alias("parent"))


def _strides(nodes: DataFrame) -> DataFrame:
    """id, parent, root, depth, size, peel of every node; root and depth are null for the residual, whose low and ptr
    are of its circle. nodes: id, parent (null for a root).

    Before the stride of length n a node points n steps up, and size and peel are of its subtree as far as n - 1 steps
    down. It sends both to the node it points to, and takes over where that one points. Where that one is closed, so
    is it then. A node on or below a circle never closes; low is the smallest node of the n steps up from it."""
    state = cut(nodes.select("id", "parent", F.col("parent").alias("ptr"), F.when(F.col("parent").isNull(), F.col("id")).alias("root"), F.when(F.col("parent").isNull(), 0).alias("depth"), F.lit(1.0).alias("size"), F.lit(0).alias("peel"), F.col("id").alias("low")))
    stride, before = 1, None
    while True:
        live = state.filter("ptr IS NOT NULL").repartition("ptr")
        told = live.groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("more"), (F.max("peel") + stride).alias("far"))
        goal = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("root").alias("top"), F.col("depth").alias("above"), F.col("low").alias("there"))
        moved = live.drop("root", "depth").join(goal, "ptr").select("id", "parent", F.col("next").alias("ptr"), F.col("top").alias("root"), (F.col("above") + stride).alias("depth"), "size", "peel", F.least("low", "there").alias("low"), (F.col("there") < F.col("low")).alias("fell"))
        both = moved.unionByName(state.filter("ptr IS NULL").select("id", "parent", "ptr", "root", "depth", "size", "peel", "low", F.lit(False).alias("fell")))
        new = both.join(told, "id", "left").select("id", "parent", "ptr", "root", "depth", (F.col("size") + F.coalesce("more", F.lit(0.0))).alias("size"), F.greatest("peel", "far").alias("peel"), "low", "fell")
        new = cut(new)
        live, goals, fell = new.agg(F.count("ptr"), F.count_distinct("ptr"), F.count_if(F.col("fell") & F.col("ptr").isNotNull())).first()
        state = new.drop("fell")
        # where a stride leaves the nodes it ends at as they were, all of these lie on circles
        if not live or ((live, goals) == before and not fell):
            return state
        stride, before = 2 * stride, (live, goals)


def _paths(closed: DataFrame) -> DataFrame:
    """(id, path) of nodes that are closed, from the roots down in strides that double."""
    deepest = closed.agg(F.max("depth")).first()[0] or 0
    state = closed.select("id", F.col("parent").alias("ptr"), F.array("id").alias("path"))
    stride = 1
    while stride <= deepest:
        up = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("path").alias("way"))
        longer = state.filter("ptr IS NOT NULL").join(up, "ptr").select("id", F.col("next").alias("ptr"), F.concat("way", "path").alias("path"))
        state = cut(longer.unionByName(state.filter("ptr IS NULL")))
        stride *= 2
    return state.select("id", "path")


def forest(edges: DataFrame, child: str = "child", parent: str = "parent", paths: bool = True) -> DataFrame:
    """node_id, parent_id, root_id, depth, subtree_size, peel_level and, unless ``paths`` is False, path of every node
    that is a child or a parent. peel_level is the round in which leaf by leaf peeling would take the node away."""
    rows = tree_rows(edges, child, parent)
    tops = rows.select(F.col("parent").alias("id")).distinct().join(rows.select("id"), "id", "left_anti").select("id", F.lit(None).cast(dict(rows.dtypes)["parent"]).alias("parent"))
    state = _strides(rows.unionByName(tops))
    closed = state.filter("ptr IS NULL")
    residual = state.filter("ptr IS NOT NULL")
    ring = residual.select("id", "parent", "ptr").join(residual.select(F.col("id").alias("ptr"), F.col("low").alias("root")), "ptr")
    trees = closed.select("id", "parent", "root", "depth", F.col("size").cast("long").alias("size"), "peel")
    out = trees.unionByName(ring.select("id", "parent", "root", F.lit(-1).alias("depth"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("int").alias("peel")))
    named = [F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), "depth", F.col("size").alias("subtree_size"), F.col("peel").alias("peel_level")]
    return out.join(_paths(closed), "id", "left").select(*named, "path") if paths else out.select(*named)


def descendants(trees: DataFrame) -> DataFrame:
    """node_id, descendant_id, distance: a row for each node and each node below it; from the paths of ``forest``."""
    steps = trees.filter("path IS NOT NULL").select(F.col("node_id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "node_id"))
    return steps.filter("at < depth").select("node_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))


# ---------------------------------------------------------------- circles


def _trim(e: DataFrame, rounds: int) -> DataFrame:
    """The edges whose ends have in- and out-edges, after so many rounds."""
    for _ in range(rounds):
        e = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        e = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    return e.select("u", "v")


def _strong(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strong components of more than one node of one part's edges, without recursion (Tarjan 1972)."""
    out: dict[int, list[int]] = {}
    for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
        out.setdefault(u, []).append(v)
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    held: list[int] = []
    on: set[int] = set()
    rows = []
    for start in list(out):
        if start in index:
            continue
        index[start] = low[start] = len(index)
        held.append(start)
        on.add(start)
        todo = [(start, iter(out[start]))]
        while todo:
            node, rest = todo[-1]
            deeper = None
            for nxt in rest:
                if nxt not in index:
                    deeper = nxt
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            if deeper is not None:
                index[deeper] = low[deeper] = len(index)
                held.append(deeper)
                on.add(deeper)
                todo.append((deeper, iter(out.get(deeper, ()))))
                continue
            todo.pop()
            if todo:
                low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
            if low[node] == index[node]:
                part = []
                while True:
                    x = held.pop()
                    on.discard(x)
                    part.append(x)
                    if x == node:
                        break
                if len(part) > 1:
                    m = min(part)
                    rows += [(x, m) for x in part]
    return pd.DataFrame(rows, columns=["node", "least"])


def _spread(e: DataFrame, value: DataFrame) -> DataFrame:
    """(node, value): the smallest value that reaches each node along the edges; value: node, value."""
    cur = cut(value)
    while True:
        s = cur
        for _ in range(TWICE):
            got = e.join(s.select(F.col("node").alias("u"), "value"), "u").select(F.col("v").alias("node"), "value")
            s = s.unionByName(got).groupBy("node").agg(F.min("value").alias("value"))
        nxt = cut(s)
        if nxt.join(cur, ["node", "value"], "left_anti").limit(1).count() == 0:
            return nxt
        cur = nxt


def _coloured(e: DataFrame) -> DataFrame:
    """Strong components of parts of any size: colour forward by the smallest node, collect backward, remove, repeat."""
    found = None
    while True:
        while True:  # trimming ends when it changes nothing
            t = cut(_trim(e, 1))
            same = t.count() == e.count()
            e = t
            if same:
                break
        if e.limit(1).count() == 0:
            break
        nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
        colour = _spread(e, nodes.select("node", F.col("node").alias("value")))
        same_colour = e.join(colour.select(F.col("node").alias("u"), F.col("value").alias("cu")), "u").join(colour.select(F.col("node").alias("v"), F.col("value").alias("cv")), "v").filter("cu = cv")
        back = cut(same_colour.select(F.col("v").alias("u"), F.col("u").alias("v")))
        reached = _spread(back, colour.filter("node = value").select("node", "value"))
        comp = reached.select("node", F.col("value").alias("least"))
        many = comp.groupBy("least").agg(F.count("*").alias("n")).filter("n > 1")
        part = cut(comp.join(many.select("least"), "least", "left_semi"))
        found = part if found is None else found.unionByName(part)
        gone = comp.select("node")
        e = cut(e.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v"))
    return found if found is not None else e.select(F.col("u").alias("node"), F.col("u").alias("least"))


def circles(edges: DataFrame, source: str = "source", target: str = "target", part_edges: int = PART_EDGES) -> DataFrame:
    """node_id, root_id of every node that can reach itself; root_id is the smallest node of its strong component."""
    kind = dict(edges.dtypes)[source]
    e = edges.select(F.col(source).alias("u"), F.col(target).cast(kind).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL").distinct()
    e = cut(e)
    own = e.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("least"))
    core = e.filter("u <> v")
    left = core.count()
    while True:
        core = cut(_trim(core, 1))
        now = core.count()
        if now >= SHRINK * left:
            break
        left = now
    part = connected_components(core, "u", "v")
    tagged = cut(core.join(part.select(F.col("node").alias("u"), "component"), "u"))
    sizes = tagged.groupBy("component").agg(F.count("*").alias("n"))
    large = cut(sizes.filter(F.col("n") > part_edges).select("component"))
    small = tagged.join(large, "component", "left_anti")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return _strong(pdf)

    found = small.groupBy("component").applyInPandas(solve, f"node {kind}, least {kind}")
    if large.limit(1).count():
        found = found.unionByName(_coloured(cut(tagged.join(large, "component", "left_semi").select("u", "v"))).select("node", "least"))
    return found.unionByName(own).groupBy(F.col("node").alias("node_id")).agg(F.min("least").alias("root_id"))

