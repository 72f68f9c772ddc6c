"""Graphs as edge tables: components, ancestors, shortest paths, walks, communities, cycles."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Shelf, ship
from . import modularity as M
from .relational import spread_join

#: Fixed depth cap of pedigree walks; it also ends walks in cyclic data.
MAX_DEPTH = 50
#: Rows of a graph that one task takes when rounds over the whole of it have left no more.
LOCAL_ROWS = 300_000
#: Edges of a component in one row at most, where edges move to the component's task.
PACKED = 128


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable. ``nodes``: (id); ``edges``: (a, b) in any order.

    Large-star and small-star steps alternate until the edges point at the roots; each step is written
    to the shared folder, so plans stay small and lost executors cost one step at most.
    """
    shelf = Shelf(nodes.sparkSession)
    now = shelf.put(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = shelf.put(spread_join(both, least, ["a"], "b").where("b > a AND m <> b").selectExpr("m AS a", "b").distinct())
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        before, now = now, shelf.put(small)
        shelf.drop(large, before)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == mark or not state[0]:
            break
        mark = state
    roots = now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return nodes.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def pedigree_depth(spark: SparkSession, edges: DataFrame, cap: int = MAX_DEPTH) -> DataFrame:
    """(root, depth): people of the longest parent-to-child chain below each root, at most ``cap``.

    ``edges``: (parent, child). One join a level; only distinct (root, node) of a level are kept.
    """
    shelf = Shelf(spark)
    edges = shelf.put(edges.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL").distinct())
    roots = edges.select("parent").distinct().join(edges.select(F.col("child").alias("parent")), "parent", "left_anti")
    level = shelf.put(roots.select(F.col("parent").alias("root"), F.col("parent").alias("node")))
    reached = [level.select("root").withColumn("depth", F.lit(1))]
    for depth in range(2, cap + 1):
        # a root may be the node of every row of a level
        down = level.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        level, before = shelf.put(down), level
        if depth > 2:
            shelf.drop(before)
        if level.isEmpty():
            break
        reached.append(shelf.put(level.select("root").distinct().withColumn("depth", F.lit(depth))))
    return reduce(DataFrame.unionByName, reached).groupBy("root").agg(F.max("depth").alias("depth"))


def ancestors(edges: DataFrame, start: DataFrame, generations: int) -> DataFrame:
    """(start, generation, ancestor): parents of parents, each ancestor at its nearest generation only.

    ``edges``: (child, parent); ``start``: (id). One join a generation, visited people excluded by an
    anti-join; a level is written out before the next, so the plan does not grow.
    """
    shelf = Shelf(edges.sparkSession)
    level = shelf.put(start.select(F.col("id").alias("start"), F.col("id").alias("ancestor"), F.lit(0).alias("generation")))
    levels = [level]
    for g in range(1, generations + 1):
        up = level.join(edges, level["ancestor"] == edges["child"]).select("start", F.col("parent").alias("ancestor")).distinct()
        seen = reduce(DataFrame.unionByName, levels)
        level = shelf.put(up.join(seen, ["start", "ancestor"], "left_anti").withColumn("generation", F.lit(g)))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).where("generation > 0").select("start", "generation", "ancestor")


def shortest_paths(edges: DataFrame, start: DataFrame, max_hops: int = 12) -> DataFrame:
    """(start, node, hops, spouses, path): least (hops, spouse edges), ties by the path's words.

    ``edges``: (src, dst, kind), directed both ways by the caller. The frontier keeps one best path a node.
    """
    shelf = Shelf(edges.sparkSession)
    best = shelf.put(start.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hops"), F.lit(0).alias("spouses"), F.array().cast("array<string>").alias("path")))
    frontier, found = best, [best]
    for _ in range(max_hops):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(
            "start", F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops"), (F.col("spouses") + (F.col("kind") == "spouse").cast("int")).alias("spouses"),
            F.concat("path", F.array("kind")).alias("path"),
        )
        one = step.groupBy("start", "node").agg(F.min(F.struct("hops", "spouses", "path")).alias("x")).select("start", "node", "x.*")
        best = reduce(DataFrame.unionByName, found)
        frontier = shelf.put(one.join(best, ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        found.append(frontier)
    return reduce(DataFrame.unionByName, found)


def walk(anchors: DataFrame, edges: DataFrame, people: DataFrame, steps: list[tuple[str, str | None]]) -> DataFrame:
    """(anchor, node): everyone at the end of the steps (kind, sex hint); unknown sex passes, the anchor not.

    One equi-join a step.
    """
    now = anchors.select(F.col("id").alias("anchor"), F.col("id").alias("node"))
    for kind, sex in steps:
        now = now.join(edges.where(F.col("kind") == kind), F.col("node") == F.col("src")).select("anchor", F.col("dst").alias("node")).distinct()
        if sex is not None:
            wrong = people.where(F.col("sex").isin("M", "F") & (F.col("sex") != sex)).select(F.col("id").alias("node"))
            now = now.join(wrong, "node", "left_anti")
    return now.where("node <> anchor").select("anchor", "node")


def family_edges(families: DataFrame, children: DataFrame) -> DataFrame:
    """(src, dst, kind) both ways: parent, child, spouse, sibling. ``families``: (family, husband, wife); ``children``: (family, child)."""
    parents = families.select("family", F.explode(F.array("husband", "wife")).alias("parent")).where("parent IS NOT NULL")
    up = children.join(parents, "family").select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    pair = families.where("husband IS NOT NULL AND wife IS NOT NULL AND husband <> wife")
    spouse = pair.selectExpr("husband AS src", "wife AS dst").unionByName(pair.selectExpr("wife AS src", "husband AS dst"))
    a, b = children.selectExpr("family", "child AS src"), children.selectExpr("family", "child AS dst")
    sibling = a.join(b, "family").where("src <> dst").select("src", "dst")
    kinds = [(up, "parent"), (up.selectExpr("dst AS src", "src AS dst"), "child"), (spouse, "spouse"), (sibling, "sibling")]
    out = None
    for df, kind in kinds:
        part = df.distinct().withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def consolidate(cm: DataFrame, shared: DataFrame, least_cm: float) -> DataFrame:
    """Match graph: the largest cM of each unordered pair, if high enough; a bare membership weighs 1.

    Membership counts only for pairs without any cM, also one below the threshold. ``cm``: (a, b, cm);
    ``shared``: (a, b).
    """
    order = lambda df: df.where("a <> b").withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    known = order(cm).groupBy("a", "b").agg(F.max("cm").alias("weight"))
    bare = order(shared).select("a", "b").distinct().join(known, ["a", "b"], "left_anti").withColumn("weight", F.lit(1.0))
    return known.where(F.col("weight") >= least_cm).unionByName(bare)


def inside_weights(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster, pairs, density, mean_cm): edges with both ends in a cluster; mean of all, and of weights above 1."""
    side = lambda k: membership.select(F.col("id").alias(k), F.col("cluster").alias(f"_{k}"))
    inner = edges.join(side("a"), "a").join(side("b"), "b").where("_a = _b")
    real = F.when(F.col("weight") > 1, F.col("weight"))
    stats = inner.groupBy(F.col("_a").alias("cluster")).agg(F.count(F.lit(1)).alias("pairs"), F.avg("weight").alias("density"), F.avg(real).alias("mean_cm"))
    return membership.select("cluster").distinct().join(stats, "cluster", "left").na.fill({"pairs": 0, "density": 0.0, "mean_cm": 0.0})


def endogamy_label(mean_cm: Column, pairs: Column, least_pairs: int = 3) -> Column:
    """The most specific population whose threshold (fixed values, cM) the mean reaches."""
    ladder = F.when(mean_cm >= 30, "AJ").when(mean_cm >= 25, "mennonite").when(mean_cm >= 20, "iberian_sephardic")
    return F.when(pairs >= least_pairs, ladder)


def greedy_modularity(edges: list[tuple], nodes: list, resolution: float = 1.0) -> dict:
    """{node: cluster}: agglomerative modularity, the best merge first, ties by least labels.

    For one group that fits a task. Clusters are named by their least member.
    """
    return _clustered(edges, nodes, resolution)


def _clustered(edges: list[tuple], nodes: list, resolution: float, seed: int | None = None) -> dict:
    where = {x: k for k, x in enumerate(nodes)}
    columns = [np.fromiter((where[e[k]] for e in edges), np.int32, len(edges)) for k in (0, 1)]
    columns.append(np.fromiter((e[2] for e in edges), float, len(edges)))
    found = _clusters(nodes, columns, resolution, seed)
    return dict(zip(nodes, (nodes[k] for k in found), strict=True))


def _clusters(names: list, edges: list, resolution: float, seed: int | None = None):
    """For each of ``names`` the place of its cluster's least one; refined if there is a seed.

    ``edges``: two arrays of places and one of weights. The list is emptied, as nothing needs them once the graph is made.
    """
    n = len(names)
    by = sorted(range(n), key=lambda k: str(names[k]))  # this order decides ties
    at, key = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int32)
    at[by] = key[sorted(range(n), key=names.__getitem__)] = np.arange(n)
    key = key[by]
    a, b, weight = edges
    edges.clear()
    for ends in (a, b):
        np.take(at, ends, out=ends, mode="clip")  # in place
    g = M.Graph(n, a, b, weight)
    del a, b, ends, weight
    cluster = M.named(M.merged(g, resolution), key)
    if seed is not None and g.total:
        order = list(range(n))
        random.Random(seed).shuffle(order)
        cluster = M.moved(g, cluster, resolution, order)
        cluster = M.named(M.connected(g, cluster), key)
    return np.array(by)[cluster[at]]


def modularity(edges: list[tuple], cluster: dict, resolution: float = 1.0) -> float:
    total = sum(w for _, _, w in edges)
    inside, degree = 0.0, {}
    for a, b, w in edges:
        for n in (a, b):
            degree[cluster[n]] = degree.get(cluster[n], 0.0) + w
        inside += w if cluster[a] == cluster[b] else 0.0
    return inside / total - resolution * sum((x / (2 * total)) ** 2 for x in degree.values()) if total else 0.0


def refined_modularity(edges: list[tuple], nodes: list, resolution: float = 1.0, seed: int = 42) -> dict:
    """{node: cluster} of a modularity not below the greedy one, each cluster connected.

    Nodes move one by one, in a seeded order, to the neighbouring cluster of largest gain until none moves;
    clusters that fall apart are split, which never lowers modularity. Named by the least member.
    """
    return _clustered(edges, nodes, resolution, seed)


def communities(edges: DataFrame, group: str, resolution: float = 1.0, refined: bool = False) -> DataFrame:
    """(group, id, cluster) by greedy modularity, ``refined`` by moves of single nodes, within each connected component of each group.

    ``edges``: (group, a, b, weight). Modularity never joins two components, so each is a task of its own.
    Edges move and are sorted by component in rows of up to PACKED, and become arrays batch by batch.
    """
    ship(edges.sparkSession)
    edges = Shelf(edges.sparkSession).put(edges.select(F.col(group).alias("g"), "a", "b", F.col("weight").cast("double").alias("weight")))
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    comp = components(ids, edges.select("a", "b"))
    # one component is one task, but its total weight is the group's
    weight = edges.groupBy("g").agg(F.sum("weight").alias("total"))
    dealt = edges.join(comp.withColumnRenamed("id", "a"), "a").join(weight, "g").select("g", "component", "total", "a", "b", "weight")
    kinds = dict(dealt.dtypes)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            x = x.sort_by([("g", "ascending"), ("component", "ascending")])
            place, new = np.arange(x.num_rows), np.ones(x.num_rows, dtype=bool)
            new[1:] = pc.or_(*(pc.not_equal(c[1:], c[:-1]) for c in (x.column("g"), x.column("component")))).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((place - np.maximum.accumulate(np.where(new, place, 0))) % PACKED == 0)
            ends = pa.array(np.append(cuts, x.num_rows), pa.int32())
            heads = [x.column(c).take(pa.array(cuts)) for c in ("g", "component", "total")]
            yield pa.RecordBatch.from_arrays([*heads, *(pa.ListArray.from_arrays(ends, x.column(c)) for c in ("a", "b", "weight"))], names=x.schema.names)

    def cluster(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a component may have millions of edges: only the places of their ends and their weights are kept
        places: dict = {}
        columns, n = [np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32), np.empty(0)], 0
        for x in batches:
            total, kind = x.column("total")[0].as_py(), x.column("a").type.value_type
            for k in (0, 1):
                ends = x.column("ab"[k]).flatten().dictionary_encode()
                place = np.array([places.setdefault(v, len(places)) for v in ends.dictionary.to_pylist()], dtype=np.int32)
                columns[k] = M.extended(columns[k], n, place[ends.indices.to_numpy()])
            columns[2] = M.extended(columns[2], n, x.column("weight").flatten().to_numpy())
            n += len(ends)
        del x, ends, place
        names = list(places)
        del places
        columns = [c[:n] for c in columns]
        found = _clusters(names, columns, resolution * float(columns[2].sum()) / total, 42 if refined else None)
        out = [pa.array([key[0].as_py()] * len(names), key[0].type), pa.array(names, kind), pa.array([names[k] for k in found], kind)]
        yield pa.RecordBatch.from_arrays(out, names=["g", "id", "cluster"])

    rows = dealt.mapInArrow(packed, ", ".join(f"{c} array<{t}>" if c in ("a", "b", "weight") else f"{c} {t}" for c, t in kinds.items()))
    out = rows.groupBy("g", "component").applyInArrow(cluster, f"g {kinds['g']}, id {kinds['a']}, cluster {kinds['a']}")
    return out.withColumnRenamed("g", group)


def cyclic(edges: DataFrame, rounds: int = MAX_DEPTH) -> DataFrame:
    """(id): nodes of directed cycles and between them: sources and sinks are trimmed until none is left."""
    shelf = Shelf(edges.sparkSession)
    now = shelf.put(edges.select("src", "dst").distinct())
    n = now.count()
    for _ in range(rounds):
        heads, tails = now.select(F.col("dst").alias("src")).distinct(), now.select(F.col("src").alias("dst")).distinct()
        now = shelf.put(now.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"))
        m = now.count()
        if m == n:
            break
        n = m
    return now.select(F.col("src").alias("id")).distinct()


def cycle_groups(edges: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(id, component): strongly connected components of two or more nodes, named by the least id.

    Trimming leaves cycles and what lies between them. While more than ``local_rows`` edges are left, every
    node takes the least id that reaches it, and those that reach that id in turn are its component; they
    go, and the rest is trimmed again. One task does the last edges, which are at most ``local_rows``.
    """
    ship(edges.sparkSession)
    shelf = Shelf(edges.sparkSession)
    kind = dict(edges.dtypes)["src"]
    done: list[DataFrame] = []
    now = edges.select("src", "dst")
    while True:
        left = cyclic(now)
        both = lambda df, ids: df.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        now = shelf.put(both(now, left).select("src", "dst").distinct())
        if now.count() <= local_rows:
            break
        # the least id that reaches a node
        color = shelf.put(left.select("id", F.col("id").alias("color")))
        while True:
            sent = spread_join(now, color.withColumnRenamed("id", "src"), ["src"], "dst").groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("new"))
            stepped = shelf.put(color.join(sent, "id", "left").select("id", F.least("color", F.coalesce("new", "color")).alias("color"), (F.col("new") < F.col("color")).alias("moved")))
            moved = not stepped.where("moved").isEmpty()
            color = stepped.drop("moved")
            if not moved:
                break
        # backwards from each color's own node, within its color
        inner = shelf.put(_colored(now, color))
        reach = shelf.put(color.where("id = color"))
        level, found = reach, [reach]
        while not level.isEmpty():
            up = level.join(inner, (level["id"] == inner["dst"]) & (level["color"] == inner["color"])).select(inner["src"].alias("id"), inner["color"]).distinct()
            level = shelf.put(up.join(reduce(DataFrame.unionByName, found), ["id", "color"], "left_anti"))
            found.append(level)
        group = reduce(DataFrame.unionByName, found).distinct()
        done.append(shelf.put(group.join(group.groupBy("color").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "color", "left_semi").select("id", F.col("color").alias("component"))))
        gone = group.select("id")
        now = shelf.put(now.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))

    def run(rows):
        import pandas as pd

        found = [(n, min(g)) for g in strong_components(rows["src"].tolist(), rows["dst"].tolist()) if len(g) > 1 for n in g]
        return pd.DataFrame(found, columns=["id", "component"])

    last = now.groupBy().applyInPandas(run, f"id {kind}, component {kind}")
    return reduce(DataFrame.unionByName, [*done, last])


def _colored(edges: DataFrame, color: DataFrame) -> DataFrame:
    """(src, dst, color) of edges whose ends have one color."""
    side = lambda end: color.select(F.col("id").alias(end), F.col("color").alias(f"_{end}"))
    both = spread_join(spread_join(edges, side("src"), ["src"], "dst"), side("dst"), ["dst"], "src")
    return both.where("_src = _dst").select("src", "dst", F.col("_src").alias("color"))


def strong_components(src: list, dst: list) -> list[list]:
    """Two depth-first searches: order of finishing forwards, then trees backwards in the opposite order."""
    ahead: dict = {}
    behind: dict = {}
    for a, b in zip(src, dst, strict=True):
        ahead.setdefault(a, []).append(b)
        behind.setdefault(b, []).append(a)

    def visit(root, graph, seen, done):
        stack = [(root, iter(graph.get(root, ())))]
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                stack.pop()
                done.append(node)
            else:
                seen.add(step)
                stack.append((step, iter(graph.get(step, ()))))

    finished: list = []
    seen: set = set()
    for n in dict.fromkeys([*src, *dst]):
        if n not in seen:
            visit(n, ahead, seen, finished)
    seen, out = set(), []
    for n in reversed(finished):
        if n not in seen:
            tree: list = []
            visit(n, behind, seen, tree)
            out.append(tree)
    return out


def mutual_clusters(matches: DataFrame, least_cm: float = 100.0) -> DataFrame:
    """(kit, a, b): strong matches that name each other in either list. ``matches``: (kit, id, cm, shared_with array)."""
    strong = matches.where(F.col("cm") >= least_cm)
    named = strong.select("kit", "id", F.explode("shared_with").alias("other"))
    other = strong.select("kit", F.col("id").alias("other"))
    return named.join(other, ["kit", "other"]).where("id <> other").select("kit", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def boost(members: Column, mrca: Column) -> Column:
    """Confidence factor of a triangulation group (fixed values): large groups are pile-ups, known ancestors help."""
    return F.when(members > 10, 0.5).when(members == 2, 1.2).when(mrca, 1.5).otherwise(1.0)
