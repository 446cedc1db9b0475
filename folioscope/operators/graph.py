"""Trees and graphs: closure, cycles, inheritance, descendants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut


def closure(edges: DataFrame) -> DataFrame:
    """(a, b, hops): every pair with a way from a to b, and the fewest hops. Ways double in length each round, so rounds grow as the logarithm of the longest."""
    known = cut(edges.select("a", "b").where("a is not null and b is not null").distinct().withColumn("hops", F.lit(1)))
    size = lambda df: df.agg(F.count(F.lit(1)), F.sum("hops")).first()
    before = size(known)
    while True:
        on = known.select(F.col("a").alias("m"), F.col("b").alias("to"), F.col("hops").alias("more"))
        longer = known.join(on, F.col("b") == F.col("m")).select("a", F.col("to").alias("b"), (F.col("hops") + F.col("more")).alias("hops"))
        known = cut(known.unionByName(longer).groupBy("a", "b").agg(F.min("hops").alias("hops")))
        now = size(known)
        if now == before:
            return known
        before = now


def on_or_between_cycles(edges: DataFrame) -> DataFrame:
    """The edges left when those are taken away, again and again, that start where none ends or end where none starts."""
    left = cut(edges.select("a", "b").where("a is not null and b is not null").distinct())
    n = left.count()
    while n:
        left = cut(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        now = left.count()
        if now == n:
            break
        n = now
    return left


#: Edges that the driver takes at once, where a graph is this small or what is left of one.
FEW_EDGES = 1 << 16


def _in_cycles(edges: list[tuple]) -> list:
    """Nodes with an edge inside a strongly connected component, by Tarjan's walk."""
    ahead: dict = {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, [])
    number, low, part, path = {}, {}, {}, []
    for root in ahead:
        if root in number:
            continue
        walk = [(root, iter(ahead[root]))]
        number[root] = low[root] = len(number)
        path.append(root)
        while walk:
            node, rest = walk[-1]
            for b in rest:
                if b not in number:
                    number[b] = low[b] = len(number)
                    path.append(b)
                    walk.append((b, iter(ahead[b])))
                    break
                if b not in part:
                    low[node] = min(low[node], number[b])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == number[node]:
                    while True:
                        x = path.pop()
                        part[x] = node
                        if x == node:
                            break
    return list({a for a, b in edges if part[a] == part[b]})


def _few(edges: DataFrame) -> DataFrame:
    """(a) of the few edges of a small graph that are on a cycle."""
    nodes = _in_cycles([tuple(r) for r in edges.select("a", "b").collect()])
    return edges.sparkSession.createDataFrame([(x,) for x in nodes], edges.select("a").schema)


def least_reached(edges: DataFrame) -> DataFrame:
    """(node, least): the least node that each one of (a, b) reaches, itself included.

    A round looks at the nodes ahead and at the least one known, so that ways grow by a factor where the order is random.
    """
    known = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("least", F.col("node")))
    while True:
        ahead = edges.select("a", "b").unionByName(known.select(F.col("node").alias("a"), F.col("least").alias("b")))
        seen = ahead.join(known.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "least", F.lit(None).cast("long").alias("own"))
        now = cut(seen.unionByName(known.withColumn("own", F.col("least"))).groupBy("node").agg(F.min("least").alias("least"), F.max("own").alias("own")))
        known = now.select("node", "least")
        if now.where("least < own").isEmpty():
            return known


def _alike(edges: DataFrame, label: DataFrame, name: str) -> DataFrame:
    """The edges whose two ends have the same label, with it."""
    ends = edges.join(label.select(F.col("node").alias("a"), F.col("least").alias(name)), "a").join(label.select(F.col("node").alias("b"), F.col("least").alias("__other")), "b")
    return cut(ends.where(F.col(name) == F.col("__other")).drop("__other"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves: those with an edge inside a strongly connected component. No table is longer than nodes and edges together.

    Few edges go to the driver. Else chains are trimmed first. Nodes get keys in a random order. A component has one least key that it reaches, and one
    that it is reached from among those; where both are the same, that node's component is whole. Edges between unlike
    nodes are on no cycle; those of unfinished components go round again.
    """
    known = cut(edges.select("a", "b").where("a is not null and b is not null").distinct())
    if known.count() <= FEW_EDGES:
        return _few(known).withColumnRenamed("a", "node")
    left = on_or_between_cycles(known)
    # xxhash64 takes one whole number to another, never two to the same.
    keys = cut(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("key", F.xxhash64(F.monotonically_increasing_id())))
    start, end = (keys.select(F.col("node").alias(c), F.col("key").alias(f"__{c}")) for c in "ab")
    rest = cut(left.join(start, "a").join(end, "b").select(F.col("__a").alias("a"), F.col("__b").alias("b")))
    found = rest.select("a").where("false")
    while rest.count() > FEW_EDGES:
        down = _alike(rest, least_reached(rest), "down")
        both = _alike(down, least_reached(down.select(F.col("b").alias("a"), F.col("a").alias("b"))), "up")
        found = found.unionByName(both.where("down = up").select("a"))
        rest = both.where("down <> up").select("a", "b")
    found = found.unionByName(_few(rest))
    return keys.join(found.distinct().withColumnRenamed("a", "key"), "key").select("node")


def batch_plan(jobs: DataFrame, targets: DataFrame) -> DataFrame:
    """(name, status, n_dependencies, unresolved, cyclic) of each job.

    jobs: name (a normalised file key). targets: name, target (normalised). Names that repeat are refused: their status
    is ``duplicate``. Every other job is ready, unresolved targets or not.
    """
    known = jobs.groupBy("name").agg(F.count(F.lit(1)).alias("__n"))
    links = targets.join(known.select(F.col("name").alias("target"), F.lit(True).alias("__known")), "target", "left")
    edges = links.where("__known").select(F.col("name").alias("a"), F.col("target").alias("b"))
    counts = links.groupBy("name").agg(F.countDistinct(F.when(F.col("__known"), F.col("target"))).alias("n_dependencies"), F.count(F.when(F.col("__known").isNull(), F.lit(1))).alias("unresolved"))
    cyclic = cyclic_nodes(edges).select(F.col("node").alias("name"), F.lit(True).alias("cyclic"))
    out = known.join(counts, "name", "left").join(cyclic, "name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("name", F.when(F.col("__n") > 1, "duplicate").otherwise("ready").alias("status"), zero("n_dependencies"), zero("unresolved"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def inherited(nodes: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Nodes (id, parent, attributes) with each attribute taken from the nearest of the node and its ancestors that states it.

    A missing parent ends the chain, and so does a chain that comes back to a node it has passed.
    """
    base = cut(nodes.select("id", "parent", *attributes))
    out = base.withColumn("__next", F.col("parent")).withColumn("__seen", F.array("id"))
    up = base.select(F.col("id").alias("__next"), F.col("parent").alias("__up"), *[F.col(a).alias(f"__{a}") for a in attributes])
    while True:
        joined = out.join(up, "__next", "left")
        seen = F.concat("__seen", F.array("__next"))
        go_on = F.col("__up").isNotNull() & ~F.array_contains(seen, F.col("__up"))
        out = cut(joined.select("id", "parent", *[F.coalesce(a, f"__{a}").alias(a) for a in attributes], F.when(go_on, F.col("__up")).alias("__next"), F.when(go_on, seen).alias("__seen")))
        if out.where("__next is not null").isEmpty():
            return out.drop("__next", "__seen")


def ancestor(path: str, tag: str):
    """The id of the nearest ancestor with a tag, from a path of (id, tag) structs, root first; null if none."""
    return F.try_element_at(F.filter(path, lambda p: p["tag"] == tag), F.lit(-1))["id"]


def forward_parents(elements: DataFrame) -> DataFrame:
    """Elements (id, parent, ord) whose parent isn't an earlier element."""
    p = elements.groupBy(F.col("id").alias("parent")).agg(F.min("ord").alias("__parent_ord"))
    return elements.join(p, "parent", "left").where("parent is not null and (__parent_ord is null or __parent_ord >= ord)").drop("__parent_ord")
