"""Property-graph operators.

Edges are one table of edge_type, edge_id, from_type, from_id, to_type, to_id, or a Graph, which has it in two orders, or
Kinds, which have a table for each type. A node is a type and an id; ids of different types may be equal.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreweave.errors import InvalidDirectionError
from loreweave.shared import cut, values

DIRECTIONS = ("out", "in", "both")
_BACK = {"out": "in", "in": "out", "both": "both"}
#: Nodes that a scan looks for by value at most; more are joined.
FEW = 200
#: Rows that are held as values at most; more are written as a table.
HELD = 2000


@dataclass(frozen=True)
class Graph:
    """Edges in order of their source and again in order of their target, so a node's edges are in few row groups."""

    by_source: DataFrame
    by_target: DataFrame


@dataclass(frozen=True)
class Kind:
    """Edges of a type that lead from nodes of one type to nodes of one type: rows of edge_id, from_id, to_id, which may repeat."""

    edge_type: str
    from_type: str
    to_type: str
    rows: DataFrame
    repeats: bool = False

    def edges(self, distinct: bool = True) -> DataFrame:
        rows = self.rows.distinct() if distinct and self.repeats else self.rows
        return rows.select(F.lit(self.edge_type).alias("edge_type"), "edge_id", F.lit(self.from_type).alias("from_type"), "from_id", F.lit(self.to_type).alias("to_type"), "to_id")


Edges = DataFrame | Graph | Sequence[Kind]


def _graph(edges: Edges) -> Graph:
    if isinstance(edges, Sequence):
        edges = reduce(DataFrame.unionByName, [k.edges() for k in edges])
    return edges if isinstance(edges, Graph) else Graph(edges, edges)


def arrows(edges: Edges, direction: str = "both", edge_types: list[str] | None = None) -> DataFrame:
    """Edges as steps from src to dst; each edge at most once in either direction."""
    if direction not in DIRECTIONS:
        raise InvalidDirectionError(direction)

    def one(rows: DataFrame, way: str, a: str, b: str) -> DataFrame:
        own = rows.filter(F.col("edge_type").isin(edge_types)) if edge_types else rows
        return own.select("edge_type", "edge_id", F.lit(way).alias("direction"), F.col(f"{a}_type").alias("src_type"), F.col(f"{a}_id").alias("src_id"), F.col(f"{b}_type").alias("dst_type"), F.col(f"{b}_id").alias("dst_id"))

    g = _graph(edges)
    out, into = one(g.by_source, "out", "from", "to"), one(g.by_target, "in", "to", "from")
    return {"out": out, "in": into}.get(direction) or out.unionByName(into)


def _near(rows: DataFrame, nodes: DataFrame, end: str = "src") -> DataFrame:
    """Rows that may end in one of the nodes (type, id).

    FEW nodes at most go into the scan as values, by which it leaves out edge types, files and row groups; for more, all
    rows are given, and the caller's join picks.
    """
    keys = nodes.select("type", "id").limit(FEW + 1).collect()
    if len(keys) > FEW:
        return rows
    by: dict[str, set[int]] = {}
    for kind, ident in keys:
        by.setdefault(kind, set()).add(ident)
    return rows.filter(reduce(Column.__or__, [(F.col(f"{end}_type") == kind) & F.col(f"{end}_id").isin(sorted(ids)) for kind, ids in sorted(by.items())], F.lit(False)))


def held_or_cut(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows and their number: HELD at most are held as values, more are written as a table."""
    few = rows.limit(HELD + 1).collect()
    if len(few) <= HELD:
        return values(rows.sparkSession, few, rows.schema), len(few)
    rows = cut(rows)
    return rows, rows.count()


def _reached(rows: DataFrame, before: int) -> tuple[DataFrame, int]:
    """held_or_cut() of rows that ``before`` nodes lead to. To look whether rows are few takes most of the work of making
    them, so where more than FEW nodes lead to them, they are made once and written."""
    if before <= FEW:
        return held_or_cut(rows)
    rows = cut(rows)
    return rows, rows.count()


@dataclass(frozen=True)
class Level:
    """Distinct nodes (type, id), their number, and if they are few, themselves."""

    nodes: DataFrame
    n: int
    known: frozenset[tuple[str, int]] | None = None

    @classmethod
    def of(cls, nodes: DataFrame) -> Level:
        few = nodes.limit(HELD + 1).collect()
        if len(few) <= HELD:
            return cls.few(nodes.sparkSession, [(r["type"], r["id"]) for r in few])
        nodes = cut(nodes)
        return cls(nodes, nodes.count())

    @classmethod
    def few(cls, spark: SparkSession, known: Iterable[tuple[str, int]]) -> Level:
        known = frozenset(known)
        return cls(values(spark, sorted(known), "type string, id long"), len(known), known)

    def where(self, other: Level, there: bool) -> Level:
        """The nodes that are in the other level, or those that aren't."""
        if self.known is not None and other.known is not None:
            return Level.few(self.nodes.sparkSession, self.known & other.known if there else self.known - other.known)
        return Level.of(self.nodes.join(other.nodes, ["type", "id"], "left_semi" if there else "left_anti"))


def neighbors(edges: Edges, seeds: DataFrame, *, direction: str = "both", edge_types: list[str] | None = None, limit: int | None = 100) -> DataFrame:
    """Steps from seeds (type, id), at most ``limit`` for each seed and edge type: out before in, then by edge; all if it is None."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    if isinstance(edges, Sequence):
        return _kind_neighbors(edges, seeds, direction, edge_types, limit)
    s = seeds.select(F.col("type").alias("src_type"), F.col("id").alias("src_id")).distinct()
    steps = _near(arrows(edges, direction, edge_types), seeds).join(s, ["src_type", "src_id"])
    if limit is None:
        return steps
    order = Window.partitionBy("src_type", "src_id", "edge_type").orderBy(F.col("direction").desc(), "edge_id", "dst_type", "dst_id")
    return steps.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= limit).drop("__rn")


def _first(rows: DataFrame, limit: int | None, by: list[str], order: list[Column], repeats: bool) -> DataFrame:
    """The first ``limit`` rows of each group, or all. Repeats, which are equal in the order, count once and are given once;
    ranks find them in the rows as sorted, so what a task limits before the exchange needs no distinct rows."""
    if limit is None:
        return rows.distinct() if repeats else rows
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("__rn", (F.dense_rank() if repeats else F.row_number()).over(w)).filter(F.col("__rn") <= limit)
    if repeats:
        rows = rows.withColumn("__last", F.lag("__rn", 1, 0).over(w)).filter("__rn <> __last").drop("__last")
    return rows.drop("__rn")


def _kind_neighbors(kinds: Sequence[Kind], seeds: DataFrame, direction: str, edge_types: list[str] | None, limit: int | None) -> DataFrame:
    """neighbors() of each kind and way on its own: only kinds that the seeds' types are on are read, and what is sorted for
    the limit are three ids. What several kinds or ways give a node by one edge type is limited once more."""
    if direction not in DIRECTIONS:
        raise InvalidDirectionError(direction)
    ways = [w for w in (("out", "from", "to"), ("in", "to", "from")) if direction in (w[0], "both")]
    wanted = [(k, *w, getattr(k, f"{w[1]}_type"), getattr(k, f"{w[2]}_type")) for k in kinds for w in ways if not edge_types or k.edge_type in edge_types]
    seeds = seeds.select("type", "id").filter(F.col("type").isin(sorted({x[4] for x in wanted})))
    few = seeds.limit(FEW + 1).collect()
    types = {r[0] for r in (few if len(few) <= FEW else seeds.select("type").distinct().collect())}
    found: dict[tuple[str, str], list[DataFrame]] = {}
    for k, way, a, b, src_type, dst_type in wanted:
        if src_type not in types:
            continue
        rows = k.rows.select(F.col(f"{a}_id").alias("src_id"), "edge_id", F.col(f"{b}_id").alias("dst_id"))
        if len(few) <= FEW:
            rows = rows.filter(F.col("src_id").isin(sorted({r[1] for r in few if r[0] == src_type and r[1] is not None})))
        else:
            rows = rows.join(seeds.filter(F.col("type") == src_type).select(F.col("id").alias("src_id")), "src_id", "left_semi")
        rows = _first(rows, limit, ["src_id"], [F.col("edge_id"), F.col("dst_id")], k.repeats)
        rows = rows.select(F.lit(src_type).alias("src_type"), "src_id", F.lit(k.edge_type).alias("edge_type"), "edge_id", F.lit(way).alias("direction"), F.lit(dst_type).alias("dst_type"), "dst_id")
        found.setdefault((src_type, k.edge_type), []).append(rows)
    if not found:
        return values(seeds.sparkSession, [], "src_type string, src_id long, edge_type string, edge_id long, direction string, dst_type string, dst_id long")
    order = [F.col("direction").desc(), F.col("edge_id"), F.col("dst_type"), F.col("dst_id")]
    union = [reduce(DataFrame.unionByName, parts) if len(parts) == 1 else _first(reduce(DataFrame.unionByName, parts), limit, ["src_type", "src_id", "edge_type"], order, False) for parts in found.values()]
    return reduce(DataFrame.unionByName, union)


def merged_neighbors(steps: DataFrame) -> DataFrame:
    """One row for each seed and neighbor, with all edges between them in order."""
    hit = F.struct((F.col("direction") != "out").alias("after"), "edge_type", "edge_id", "direction")
    grouped = steps.groupBy("src_type", "src_id", "dst_type", "dst_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    return grouped.withColumn("edge_type", F.col("hits")[0]["edge_type"]).withColumn("directions", F.array_distinct(F.col("hits.direction")))


def _depth(max_depth: int) -> None:
    if max_depth < 1:
        raise ValueError("max_depth must be at least 1")


def traverse_nodes(edges: Edges, start: DataFrame, *, direction: str = "out", edge_types: list[str] | None = None, max_depth: int = 3, enough: int | None = None) -> DataFrame:
    """type, id, min_depth and paths_count (shortest paths) of nodes reached from start (type, id), without it.

    One join for each hop takes the whole frontier a step on; nodes seen before are left out. The search stops with the
    hop that brings ``enough`` nodes.
    """
    _depth(max_depth)
    steps = arrows(edges, direction, edge_types)
    frontier = start.select("type", "id", F.lit(1).cast("long").alias("paths_count"))
    seen = start.select("type", "id", F.lit(0).alias("min_depth"), F.lit(1).cast("long").alias("paths_count"))
    found = n = 0
    for depth in range(1, max_depth + 1):
        on = (F.col("type") == F.col("src_type")) & (F.col("id") == F.col("src_id"))
        reached = frontier.join(_near(steps, frontier), on).groupBy(F.col("dst_type").alias("type"), F.col("dst_id").alias("id")).agg(F.sum("paths_count").alias("paths_count"))
        frontier, n = _reached(reached.join(seen, ["type", "id"], "left_anti"), n)
        if not n:
            break
        seen = seen.unionByName(frontier.select("type", "id", F.lit(depth).alias("min_depth"), "paths_count"))
        found += n
        if enough is not None and found >= enough:
            break
    return seen.filter("min_depth > 0")


def _key(kind: str, ident: str) -> Column:
    return F.concat(F.col(kind), F.lit(":"), F.col(ident).cast("string"))


def _trivial(nodes: DataFrame) -> DataFrame:
    """Paths of one node each."""
    return nodes.select(F.array(_key("type", "id")).alias("nodes"), F.array().cast("array<string>").alias("edges"), F.col("type").alias("end_type"), F.col("id").alias("end_id"))


def _extended(here: DataFrame, steps: DataFrame, most: int | None, length: int, allowed: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Simple paths that are a step longer than those here, of ``length`` steps by then, and how many there are; with
    ``most``, the first by nodes. ``allowed``: the nodes (type, id) that they may end in.

    What follows each end node is looked up once, however many paths end there: its distinct neighbors, with the least of
    parallel edges. A path holds ``length`` nodes, so its first ``most`` ways on are among the first most + length of them; a
    hub gives no more, and its edges are cut to these where they are read.
    """
    ends = here.select(F.col("end_type").alias("type"), F.col("end_id").alias("id")).distinct()
    on = (F.col("type") == F.col("src_type")) & (F.col("id") == F.col("src_id"))
    ways = _near(steps, ends).join(ends, on).drop("type", "id")
    if allowed is not None:
        ways = _near(ways, allowed, "dst").join(allowed, (F.col("dst_type") == F.col("type")) & (F.col("dst_id") == F.col("id")), "left_semi")
    ways = ways.groupBy("src_type", "src_id", "dst_type", "dst_id").agg(F.min(_key("edge_type", "edge_id")).alias("edge")).withColumn("dst", _key("dst_type", "dst_id"))
    if most is not None:
        first = Window.partitionBy("src_type", "src_id").orderBy("dst")
        ways = ways.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") <= most + length)
    moved = here.join(ways, (F.col("end_type") == F.col("src_type")) & (F.col("end_id") == F.col("src_id"))).filter(~F.array_contains("nodes", F.col("dst")))
    moved = moved.select(F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("edges", F.col("edge")).alias("edges"), F.col("dst_type").alias("end_type"), F.col("dst_id").alias("end_id"))
    return held_or_cut(moved if most is None else moved.orderBy("nodes").limit(most))


def _shortest(found: list[DataFrame], limit: int | None) -> DataFrame:
    """Paths by length: found[i] has those of one length, given as its column depth."""
    out = reduce(DataFrame.unionByName, [f.select("nodes", "edges", "depth") for f in found])
    return out if limit is None else out.orderBy("depth", "nodes").limit(limit)


def paths(edges: Edges, start: DataFrame, *, direction: str = "out", edge_types: list[str] | None = None, max_depth: int = 3, to: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Simple paths from start: nodes (array of type:id), edges (array of type:id) and depth.

    Parallel edges count as one path, with the least of them. With ``to``, only paths that end there, which go on no
    further. The search stops with the hop that completes ``limit`` paths, so the shortest are found first, and of those
    of one length the first by nodes; a hop gives no more than are wanted.
    """
    _depth(max_depth)
    steps = arrows(edges, direction, edge_types)
    if to is not None:
        return _between(steps, arrows(edges, _BACK[direction], edge_types), start, to, max_depth, limit)
    here, found, n = _trivial(start), [_trivial(start).limit(0).withColumn("depth", F.lit(0))], 0
    for depth in range(1, max_depth + 1):
        here, more = _extended(here, steps, None if limit is None else limit - n, depth)
        if not more:
            break
        found.append(here.withColumn("depth", F.lit(depth)))
        n += more
        if limit is not None and n >= limit:
            break
    return _shortest(found, limit)


def _next(level: Level, steps: DataFrame, within: Level | None = None, without: Level | None = None) -> Level:
    """The nodes a step from a level: those in ``within``, those not in ``without``."""
    on = (F.col("type") == F.col("src_type")) & (F.col("id") == F.col("src_id"))
    there = _near(steps, level.nodes).join(level.nodes, on, "left_semi").select(F.col("dst_type").alias("type"), F.col("dst_id").alias("id")).distinct()
    for other, how in ((within, "left_semi"), (without, "left_anti")):
        there = there if other is None else there.join(other.nodes, ["type", "id"], how)
    return Level.of(there)


def _between(steps: DataFrame, back: DataFrame, start: DataFrame, goal: DataFrame, max_depth: int, limit: int | None) -> DataFrame:
    """Paths from start to goal, length by length.

    Levels of nodes, which are sets and not paths, grow from either side, the smaller one first: those that are so many
    steps from the start or before the goal. Paths of a length are looked for only if its levels meet, and a path is extended
    only to nodes from where the goal is in reach of the steps that are left. With a limit, a hop keeps the first paths by
    nodes, as many as are wanted, or FEW. These begin the first of all paths, so if enough of them arrive, they are the
    ones; if nodes that paths may not visit twice have led some astray, the hops are made anew with more.
    """
    goal, start = Level.of(goal.select("type", "id").distinct()), Level.of(start.select("type", "id").distinct())
    at_goal = start.where(goal, True)
    ahead, behind = [start.where(goal, False)], [goal]
    found, n = [_trivial(at_goal.nodes).withColumn("depth", F.lit(0))], at_goal.n
    for length in range(1, max_depth + 1):
        if limit is not None and n >= limit or not ahead[0].n:
            break
        # the side that has fewer nodes to step from; the goal itself is no level that paths go through
        side, way = (behind, back) if length == 1 or behind[-1].n < ahead[-1].n else (ahead, steps)
        side.append(_next(side[-1], way, without=goal))
        if not side[-1].n:
            break
        half = len(ahead) - 1
        allowed = {half: ahead[half].where(behind[length - half], True)}
        if not allowed[half].n:
            continue
        # before the middle, a node is on a path only if a node of the next level is
        for at in range(half - 1, 0, -1):
            allowed[at] = ahead[at] if ahead[at].n <= FEW else _next(allowed[at + 1], back, within=ahead[at])
        allowed |= {at: behind[length - at] for at in range(half + 1, length + 1)}
        wanted = None if limit is None else limit - n
        most = None if wanted is None else max(wanted, FEW)
        while True:
            here, cut_off, more = _trivial(ahead[0].nodes), False, 0
            for at in range(1, length + 1):
                here, more = _extended(here, steps, most, at, allowed[at].nodes)
                cut_off |= more == most
                if not more:
                    break
            if most is None or more >= wanted or not cut_off:
                break
            most *= 10
        if more:
            found.append((here if wanted is None else here.orderBy("nodes").limit(wanted)).withColumn("depth", F.lit(length)))
            n += more if wanted is None else min(more, wanted)
    return _shortest(found, limit)


def context(edges: Edges, seeds: DataFrame, *, direction: str = "both", edge_types: list[str] | None = None, max_depth: int = 1, limit: int | None = 100) -> DataFrame:
    """Around each of many seeds (type, id), the nodes within max_depth steps, itself left out: seed_type, seed_id, depth, type,
    id; the first of the steps that lead there (out before in, then by edge, then by the node it comes from): edge_type, edge_id,
    direction, from_type, from_id; and n_edges, how many edges that node has with it. ``limit``: steps of a node and edge type.

    Seeds search in blocks of 64, of which a node has one row: a bit says which of them have come there. A hop is one join for all
    seeds, in which a block's seeds share a row, and the bits that a node had before are taken off.
    """
    _depth(max_depth)
    if direction not in DIRECTIONS:
        raise InvalidDirectionError(direction)
    own = cut(seeds.select("type", "id").distinct().repartitionByRange("type", "id").withColumn("__part", F.spark_partition_id()))
    at = F.row_number().over(Window.partitionBy("__part").orderBy("type", "id")) - 1
    own = own.withColumn("__at", at).select("type", "id", (F.shiftleft(F.col("__part").cast("long"), 32) + F.shiftright("__at", 6)).alias("block"), F.pmod("__at", F.lit(64)).alias("bit"))
    frontier = own.groupBy("block", "type", "id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("mask"))
    seen, found, n = frontier, [], own.count()
    first = F.min(F.struct((F.col("direction") != "out").alias("after"), "edge_type", "edge_id", "direction")).alias("step")
    for depth in range(1, max_depth + 1):
        steps = neighbors(edges, frontier, direction=direction, edge_types=edge_types, limit=limit)
        ways = steps.groupBy("src_type", "src_id", "dst_type", "dst_id").agg(first, F.count(F.lit(1)).alias("n_edges"))
        moved = frontier.join(ways, (F.col("type") == F.col("src_type")) & (F.col("id") == F.col("src_id"))).drop("type", "id")
        before = seen.select("block", F.col("type").alias("dst_type"), F.col("id").alias("dst_id"), F.col("mask").alias("had"))
        fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
        here, n = _reached(moved.join(before, ["block", "dst_type", "dst_id"], "left").withColumn("mask", fresh).filter("mask <> 0").drop("had"), n)
        if not n:
            break
        found.append(here.withColumn("depth", F.lit(depth)))
        if depth < max_depth:
            frontier, n = _reached(here.groupBy("block", F.col("dst_type").alias("type"), F.col("dst_id").alias("id")).agg(F.bit_or("mask").alias("mask")), n)
            seen, _ = _reached(seen.unionByName(frontier).groupBy("block", "type", "id").agg(F.bit_or("mask").alias("mask")), n)
    if not found:
        return _told(own.limit(0).selectExpr("type AS seed_type", "id AS seed_id", "0 AS depth", "type", "id", "'' AS edge_type", "0L AS edge_id", "'' AS direction", "type AS from_type", "id AS from_id", "0L AS n_edges"))
    rows = reduce(DataFrame.unionByName, found)
    rows = rows.withColumn("bit", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("bit_get", F.col("mask"), b) == 1)))
    via = F.min(F.struct("step.after", "step.edge_type", "step.edge_id", F.col("src_type").alias("from_type"), F.col("src_id").alias("from_id"), "step.direction", "n_edges")).alias("via")
    told = rows.groupBy("block", "bit", "depth", F.col("dst_type").alias("type"), F.col("dst_id").alias("id")).agg(via)
    return _told(told.join(own.select("block", "bit", F.col("type").alias("seed_type"), F.col("id").alias("seed_id")), ["block", "bit"]).select("*", "via.*"))


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("seed_type", "seed_id", "depth", "type", "id", "edge_type", "edge_id", "direction", "from_type", "from_id", "n_edges")


def subgraph(edges: Edges, center: DataFrame, *, edge_types: list[str] | None = None, max_depth: int = 2, node_limit: int = 100, edge_limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """Nodes around center (type, id, min_depth), itself first, and the edges between them; undirected."""
    found = traverse_nodes(edges, center, direction="both", edge_types=edge_types, max_depth=max_depth, enough=node_limit).drop("paths_count")
    nodes = cut(center.select("type", "id", F.lit(0).alias("min_depth")).unionByName(found).orderBy("min_depth", "type", "id").limit(node_limit))
    own = _graph(edges).by_source
    own = _near(own.filter(F.col("edge_type").isin(edge_types)) if edge_types else own, nodes, "from")
    for end in ("from", "to"):
        own = own.join(nodes.select(F.col("type").alias(f"{end}_type"), F.col("id").alias(f"{end}_id")), [f"{end}_type", f"{end}_id"], "left_semi")
    return nodes, own.orderBy("edge_type", "edge_id").limit(edge_limit)
