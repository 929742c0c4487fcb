"""Strongly connected components of edge tables of any shape, in rounds that long chains don't add to.

A round first contracts: nodes with one way in and one way out are chains, and
pointer doubling finds both ends of all chains at once, whatever their lengths; a
chain becomes one edge. Then it trims nodes that have no way in or none out. What
neither shrinks is coloured: the least name that reaches a node is its colour, and
the nodes of a colour that reach back to it are a component. Contracted chains are
placed at the end: a chain whose ends share a component belongs to it.

Every step is a written table, so that a lost executor costs one step; tables that
nothing reads any more are deleted.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.graphs import reach
from ledgerloom.operators.written import discarded, written


class Rounds:
    """How many jobs of each kind a run took, for tests and for whoever wants to know."""

    def __init__(self) -> None:
        self.doublings = self.contractions = self.colourings = self.levels = 0


def jumped(hops: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """(way, node, to, least, open) of ``hops`` (way, node, next): the first node along the hops of a way that has none itself, by pointer doubling.

    Where hops lead into a ring, ``open`` is true and ``least`` is the ring's least
    node if the node is on it. It takes as many passes as the logarithm of the
    longest chain or ring, since it ends when a pass changes nothing.
    """
    own = hops.select("way", "node", F.col("next").alias("to"))
    goes = own.select("way", F.col("node").alias("to"), F.lit(True).alias("goes"))
    start = own.join(goes, ["way", "to"], "left").select("way", "node", "to", F.col("node").alias("least"), F.coalesce("goes", F.lit(False)).alias("open"), F.lit(True).alias("lower"))
    now = written(start, "jumps")
    n_open = now.where("open").count()
    while n_open:
        far = now.select("way", F.col("node").alias("to"), F.col("to").alias("far"), F.col("least").alias("far_least"), F.col("open").alias("far_open"))
        # what a closed node points to has no hop, so that it finds nothing here and stays
        both = now.join(far, ["way", "to"], "left")
        moved = both.select("way", "node", F.coalesce("far", "to").alias("to"), F.least("least", "far_least").alias("least"), F.coalesce("far_open", F.lit(False)).alias("open"), F.coalesce(F.col("far_least") < F.col("least"), F.lit(False)).alias("lower"))
        after = written(moved, "jumps")
        left, lower = after.agg(F.count_if("open"), F.count_if(F.col("open") & F.col("lower"))).first()
        discarded(now)
        now, settled, n_open = after, left == n_open and not lower, left
        if rounds:
            rounds.doublings += 1
        if settled:
            break
    return now


def one_way(hops: DataFrame) -> DataFrame:
    return hops.select(F.lit(0).alias("way"), "node", "next")


def _coloured(graph: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, component): for each colour, the nodes that its least name reaches and that reach it."""
    ends = graph.select(F.col("src").alias("node")).union(graph.select("dst")).distinct()
    colour = written(ends.select("node", F.col("node").alias("colour")), "colours")
    front = colour
    while not front.isEmpty():
        rounds.colourings += 1
        told = front.join(graph, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("told"))
        better = written(told.join(colour, "node").where("told < colour").select("node", F.col("told").alias("colour")), "front")
        after = written(colour.join(better.select("node", F.col("colour").alias("now")), "node", "left").select("node", F.coalesce("now", "colour").alias("colour")), "colours")
        discarded(colour)
        colour, front = after, better
    a, b = (colour.select(F.col("node").alias(x), F.col("colour").alias(f"colour_{x}")) for x in ("src", "dst"))
    back = graph.join(a, "src").join(b, "dst").where("colour_src = colour_dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    own = reach(back, colour.where("node = colour").select("node"))
    return written(own.join(colour, "node").select("node", F.col("colour").alias("component")), "component")


def components(edges: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """(node, component, ring) of every node of ``edges`` (src, dst): the component is named by one of its nodes.

    ``ring`` tells components of several nodes, and nodes with an edge to themselves.
    Repeated edges count once; edges with a null end are left out; a graph without
    edges has no rows.
    """
    rounds = rounds or Rounds()
    every = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    graph = written(every.where("src <> dst"), "graph")
    found, chains = [], []
    while not graph.isEmpty():
        rounds.contractions += 1
        out = graph.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.first("dst").alias("next"))
        into = graph.groupBy(F.col("dst").alias("to_node")).agg(F.count("*").alias("n_in"), F.first("src").alias("before"))
        degrees = written(out.join(into, F.col("node") == F.col("to_node"), "full_outer").select(F.coalesce("node", "to_node").alias("node"), F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"), "next", "before"), "degrees")
        inner = degrees.where("n_in = 1 and n_out = 1")
        n_nodes, n_inner, n_ends = degrees.agg(F.count("*"), F.count_if((F.col("n_in") == 1) & (F.col("n_out") == 1)), F.count_if((F.col("n_in") == 0) | (F.col("n_out") == 0))).first()
        left = graph
        if n_inner:
            ways = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("next").alias("next")), F.struct(F.lit(1).alias("way"), F.col("before").alias("next"))))
            ends = jumped(inner.select("node", ways.alias("x")).select("node", "x.way", "x.next"), rounds)
            found.append(ends.where("open and way = 0").select("node", F.col("least").alias("component")))
            end = lambda way, name: ends.where(f"not open and way = {way}").select("node", F.col("to").alias(name))  # noqa: B023, E731
            chain = written(end(0, "tail").join(end(1, "head"), "node"), "chain")
            chains.append(chain)
            own = inner.select("node")
            kept = graph.join(own, F.col("src") == F.col("node"), "left_anti").join(own, F.col("dst") == F.col("node"), "left_anti")
            left = kept.union(chain.select("head", "tail")).where("src <> dst").distinct()
        if n_ends:
            through = degrees.where("n_in > 0 and n_out > 0").select("node")
            left = left.join(through, F.col("src") == F.col("node"), "left_semi").join(through, F.col("dst") == F.col("node"), "left_semi")
        if not n_inner and not n_ends:
            own = _coloured(graph, rounds)
            found.append(own)
            a, b = (own.select(F.col("node").alias(x)) for x in ("src", "dst"))
            left = graph.join(a, "src", "left_anti").join(b, "dst", "left_anti").select("src", "dst")
        after = written(left, "graph")
        discarded(graph, degrees)
        graph = after
    names = every.select(F.col("src").alias("node")).union(every.select("dst")).distinct()
    if not found and not chains:
        placed = names.select("node", F.col("node").alias("component")).limit(0)
    else:
        placed = None
        for part in found:
            placed = part if placed is None else placed.unionByName(part)
        for chain in reversed(chains):  # the ends of a chain were placed in a later round
            head, tail = (F.col(c) for c in ("head_component", "tail_component"))
            known = lambda end: placed.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))  # noqa: B023, E731
            both = chain if placed is None else chain.join(known("head"), "head", "left").join(known("tail"), "tail", "left")
            named = both.withColumns({"head_component": F.col("head"), "tail_component": F.col("tail")}) if placed is None else both.withColumns({f"{e}_component": F.coalesce(f"{e}_component", e) for e in ("head", "tail")})
            own = written(named.where(head == tail).select("node", head.alias("component")), "placed")
            placed = own if placed is None else placed.unionByName(own)
    whole = written(names.join(placed.select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")
    looped = every.where("src = dst").select(F.col("src").alias("component"), F.lit(1).alias("loop"))
    sizes = whole.groupBy("component").agg(F.count("*").alias("n")).join(looped, "component", "left")
    return whole.join(sizes, "component").select("node", "component", ((F.col("n") > 1) | F.col("loop").isNotNull()).alias("ring"))


def unplaceable(edges: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """(node): what no topological order can place, none where the graph is acyclic: nodes of rings, and what rings lead to.

    Nodes with one way in share the fate of what leads to them, so that they are
    jumped over before the rest is searched level by level.
    """
    rounds = rounds or Rounds()
    every = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    rings = written(components(every, rounds).where("ring").select("node"), "rings")
    if rings.isEmpty():
        return rings
    free = every.join(rings, F.col("dst") == F.col("node"), "left_anti")
    only = free.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.first("src").alias("next")).where("n = 1")
    leaders = jumped(one_way(only), rounds).select("node", F.col("to").alias("leader"))
    led = free.join(leaders, F.col("dst") == F.col("node"), "left_anti").join(leaders, F.col("src") == F.col("node"), "left")
    after = reach(led.select(F.coalesce("leader", "src").alias("src"), "dst"), rings).select("node")
    hit = written(after, "reached")
    followers = leaders.join(hit.select(F.col("node").alias("leader")), "leader", "left_semi").select("node")
    return hit.union(followers).distinct()


def ring_members(successors: DataFrame) -> DataFrame:
    """(node): nodes on rings, where each ``node`` has one ``next`` (null at an end); passes follow the longest chain, not the number of nodes.

    A pointer that is still open after the last pass has gone round a ring, so it
    points to one of the ring's nodes, and every node of a ring is pointed to.
    """
    now = jumped(one_way(successors.where("next is not null")))
    return now.where("open").select(F.col("to").alias("node")).distinct()
