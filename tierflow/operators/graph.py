"""Graph operators: cycles, depth, reach. Rounds are driven from the driver, data stays in tables.

Rounds are few because chains are shortened first: pointers along them are doubled, so a
chain of n nodes takes log n joins. What is left branches at every node; there a round
goes one level. Tables of finished rounds are deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.shared import dropped, stored


class Seen:
    """Rows met over many rounds; what is stored anew now and then keeps the plan short."""

    def __init__(self, first: DataFrame, most: int = 8):
        self.parts, self.most = [first], most

    def rows(self) -> DataFrame:
        return reduce(DataFrame.union, self.parts)

    def add(self, more: DataFrame) -> None:
        self.parts.append(more)
        if len(self.parts) > self.most:
            whole = stored(self.rows(), "seen")
            for part in self.parts[:-1]:  # the last one may still be the front
                dropped(part)
            self.parts = [whole]


def dependencies_of(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("source") == path).select(F.col("target").alias("path")).distinct()


def dependents_of(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("target") == path).select(F.col("source").alias("path")).distinct()


def edges_between(edges: DataFrame, source: str, target: str) -> DataFrame:
    return edges.where((F.col("source") == source) & (F.col("target") == target))


def stats(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``files, imports, type_only, sources, targets`` in one row."""
    found = edges.agg(F.count("*").alias("imports"), F.count_if("is_type_only").alias("type_only"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))
    return files.agg(F.count("*").alias("files")).crossJoin(found)  # one row each


def adjacency(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``path, n``: distinct targets of every file, 0 where there are none."""
    found = edges.select(F.col("source").alias("path"), "target").distinct().groupBy("path").agg(F.count("*").alias("n"))
    return files.join(found, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))


def self_loops(graph: DataFrame) -> DataFrame:
    """Nodes of ``graph`` (s, t) that point to themselves."""
    return graph.where("s = t").select(F.col("s").alias("node")).distinct()


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join between executors. Rounds join tables of nodes many times over; each one that is broadcast goes through the driver."""
    return left.join(right.hint("merge"), on, how)


def _doubled(graph: DataFrame) -> list[DataFrame]:
    """Jumps of 1, 2, 4 .. steps of a graph with one successor a node, until they exceed the number of nodes."""
    jump, steps, out = stored(graph.select("s", "t"), "jump"), 1, []
    nodes = jump.count()
    while True:
        out.append(jump)
        if steps > nodes:
            return out
        jump = stored(_met(jump, jump.select(F.col("s").alias("t"), F.col("t").alias("u")), "t").select("s", F.col("u").alias("t")), "jump")
        steps *= 2


def successor_cycles(graph: DataFrame, jumps: list[DataFrame] | None = None) -> DataFrame:
    """``node, component``: nodes on cycles of a graph with one successor a node; the smallest node names the cycle.

    A jump further than there are nodes ends on a cycle. Smallest names follow by
    doubling as well, so a cycle of n nodes takes log n joins.
    """
    jumps = jumps or _doubled(graph)
    on = stored(jumps[-1].select(F.col("t").alias("s")).distinct(), "cycle")
    least = on.select("s", F.col("s").alias("m"))
    for jump in jumps:
        ahead = least.select(F.col("s").alias("t"), F.col("m").alias("n"))
        least = stored(_met(_met(least, jump, "s"), ahead, "t").select("s", F.least("m", "n").alias("m")), "least")
    return least.select(F.col("s").alias("node"), F.col("m").alias("component"))


def successor_depth(graph: DataFrame) -> DataFrame:
    """``node, depth``: edges of the longest chain from each node of a graph with one successor a node; a cycle counts once round."""
    jumps = _doubled(graph)
    cycles = successor_cycles(graph, jumps)
    size = cycles.groupBy("component").agg(F.count("*").alias("size"))
    on = stored(_met(cycles, size, "component").select("node", "size"), "sizes")
    # walk as far as possible without reaching the cycle, largest jumps first
    at = _met(graph, on.select(F.col("node").alias("s")), "s", "left_anti").select("s", F.col("s").alias("at"), F.lit(0).cast("long").alias("d"))
    for k, jump in reversed(list(enumerate(jumps))):
        to = _met(_met(at, jump.select(F.col("s").alias("at"), F.col("t").alias("to")), "at"), on.select(F.col("node").alias("to"), F.lit(True).alias("hit")), "to", "left")
        at = stored(to.select("s", F.when(F.col("hit"), F.col("at")).otherwise(F.col("to")).alias("at"), F.when(F.col("hit"), F.col("d")).otherwise(F.col("d") + 2**k).alias("d")), "walk")
    entry = _met(_met(at, graph.select(F.col("s").alias("at"), F.col("t").alias("node")), "at"), on, "node")
    return entry.select(F.col("s").alias("node"), (F.col("d") + 1 + F.col("size")).alias("depth")).union(on.select("node", F.col("size").cast("long")))


def _with_nodes(edges: DataFrame) -> DataFrame:
    """``v, n_in, n_out`` of the distinct edges (s, t)."""
    ends = edges.select(F.col("s").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("t", F.lit(1), F.lit(0)))
    return ends.groupBy("v").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def unary_chains(edges: DataFrame) -> tuple[DataFrame, int]:
    """``v, first, last, least, ring`` of nodes with one edge in and one out, and how many there are.

    ``first`` and ``last`` are the branching nodes before and after the chain that the node is in. On
    a ``ring`` of such nodes alone there are none, and ``least`` is its smallest node. Edges (s, t) are
    distinct and without loops. Pointers are doubled in both directions, so a chain of n nodes takes log n rounds.
    """
    unary = stored(_with_nodes(edges).where("n_in = 1 and n_out = 1").select("v"), "unary")
    n = unary.count()
    if not n:
        return unary.select("v", F.col("v").alias("first"), F.col("v").alias("last"), F.col("v").alias("least"), F.lit(False).alias("ring")), 0
    ahead = edges.join(unary.withColumnRenamed("v", "s"), "s").select(F.col("s").alias("v"), F.col("t").alias("last"))
    behind = edges.join(unary.withColumnRenamed("v", "t"), "t").select(F.col("t").alias("v"), F.col("s").alias("first"))
    at, steps = stored(ahead.join(behind, "v").select("v", "first", "last", F.col("v").alias("least"), F.lit(True).alias("ring")), "chains"), 1
    while True:
        on = at.select(F.col("v").alias("last"), F.col("last").alias("last2"), F.col("least").alias("least2"))
        back = at.select(F.col("v").alias("first"), F.col("first").alias("first2"))
        new = at.join(on, "last", "left").join(back, "first", "left")
        new = stored(new.select("v", F.coalesce("first2", "first").alias("first"), F.coalesce("last2", "last").alias("last"), F.least("least", F.coalesce("least2", "least")).alias("least"), F.col("last2").isNotNull().alias("ring")), "chains")
        dropped(at)
        at, steps = new, steps * 2
        # a chain of all n nodes is only known to end once pointers of n steps were followed
        if steps >= 2 * n or not at.where("ring").limit(1).count():
            dropped(unary)
            return at, n


def strong_components(graph: DataFrame) -> DataFrame:
    """``node, component`` of all nodes on cycles of any graph (s, t); the smallest node names the component.

    Nodes without a way in or out are trimmed and chains shortened to one edge, in turns, until
    neither helps. On what is left the node of the smallest hash that reaches each node
    colours it, and what reaches that node backwards within its colour is its component;
    then it starts again on the rest. A node of a shortened chain is in the component that holds both its ends;
    one with a loop is a component of its own only if nothing that was found later holds it.
    """
    every = stored(graph.where("s is not null and t is not null").select("s", "t").distinct(), "graph")
    left = stored(every.where("s <> t"), "graph")
    found, chains = [], []

    def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
        new = stored(new, "graph")
        dropped(old)
        return new

    n = left.count()
    while n:
        shortened = True
        while n and shortened:
            trimmed = 0
            while n and trimmed < 3:
                left = replaced(left, left.join(left.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(left.select(F.col("s").alias("t")).distinct(), "t", "left_semi").select("s", "t"))
                before, n, trimmed = n, left.count(), trimmed + 1
                if n == before:
                    break
            shortened = bool(n) and n < before
            if n:
                at, many = unary_chains(left)
                if many:
                    shortened = True
                    found.append(at.where("ring").select(F.col("v").alias("node"), F.col("least").alias("component")))
                    chain = at.where("not ring")
                    own = at.select("v")
                    rest = left.join(own.withColumnRenamed("v", "s"), "s", "left_anti").join(own.withColumnRenamed("v", "t"), "t", "left_anti").select("s", "t")
                    bridged = stored(rest.union(chain.select(F.col("first").alias("s"), F.col("last").alias("t"))).distinct(), "bridged")
                    chains.append((chain, bridged.where("s = t").select(F.col("s").alias("node"))))
                    left = replaced(left, bridged.where("s <> t"))
                    n = left.count()
        if not n:
            break
        reach = _coloured(left)
        found.append(_named(reach))
        left = replaced(left, left.join(reach.select(F.col("v").alias("s")), "s", "left_anti").join(reach.select(F.col("v").alias("t")), "t", "left_anti").select("s", "t"))
        n = left.count()
    nothing = every.select(F.col("s").alias("node"), F.col("s").alias("component")).limit(0)
    known = stored(reduce(DataFrame.union, found, nothing), "components")

    def with_loops(known: DataFrame, loops: DataFrame) -> DataFrame:
        return known.union(loops.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))

    for chain, loops in reversed(chains):
        known = replaced(known, with_loops(known, loops))
        ends = chain.join(known.select(F.col("node").alias("first"), F.col("component").alias("c")), "first").join(known.select(F.col("node").alias("last"), F.col("component").alias("c2")), "last")
        known = replaced(known, known.union(ends.where("c = c2").select(F.col("v").alias("node"), F.col("c").alias("component"))))
    known = replaced(known, with_loops(known, every.where("s = t").select(F.col("s").alias("node"))))
    names = known.groupBy("component").agg(F.min("node").alias("least"))
    return known.join(names, "component").select("node", F.col("least").alias("component"))


def _coloured(left: DataFrame) -> DataFrame:
    """``v, c``: nodes that the node of their colour reaches and that reach it, for every colour of a graph (s, t)."""
    colour = stored(left.select(F.col("s").alias("v")).union(left.select("t")).distinct().select("v", F.struct(F.xxhash64("v").alias("p"), "v").alias("c")), "colour")
    while True:
        pushed = left.join(colour.select(F.col("v").alias("s"), "c"), "s").select(F.col("t").alias("v"), "c")
        new = stored(colour.union(pushed).groupBy("v").agg(F.min("c").alias("c")), "colour")
        moved = new.join(colour, ["v", "c"], "left_anti").limit(1).count()
        dropped(colour)
        colour = new
        if not moved:
            break
    inner = left.join(colour.select(F.col("v").alias("s"), "c"), "s").join(colour.select(F.col("v").alias("t"), F.col("c").alias("c2")), "t").where("c = c2").select("s", "t", "c")
    inner = stored(inner, "inner")
    front = stored(colour.where("v = c.v").select("v", "c"), "reach")
    reach = Seen(front)
    while True:
        back = inner.join(front.select(F.col("v").alias("t"), "c"), ["t", "c"]).select(F.col("s").alias("v"), "c").distinct()
        front = stored(back.join(reach.rows(), ["v", "c"], "left_anti"), "reach")
        if not front.limit(1).count():
            break
        reach.add(front)
    out = stored(reach.rows(), "reach")
    for table in (colour, inner, *reach.parts):
        dropped(table)
    return out


def _named(reach: DataFrame) -> DataFrame:
    """``node, component`` of the colours with more than one node."""
    size = reach.groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("component")).where("n > 1")
    return stored(reach.join(size, "c").select(F.col("v").alias("node"), "component"), "named")


def reachable(graph: DataFrame, start: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``node, hops``: what ``start`` (node) reaches, with the fewest steps; at most ``max_rounds`` steps if given."""
    front, hop = stored(start.select("node", F.lit(0).alias("hops")).distinct(), "reach"), 0
    graph = stored(graph.select("s", "t").distinct(), "graph")
    seen = Seen(front)
    while max_rounds is None or hop < max_rounds:
        hop += 1
        ahead = _met(front.select(F.col("node").alias("s")), graph, "s").select(F.col("t").alias("node")).distinct()
        front = stored(_met(ahead, seen.rows(), "node", "left_anti").select("node", F.lit(hop).alias("hops")), "front")
        if not front.limit(1).count():
            break
        seen.add(front)
    return seen.rows()


def cycle_paths(graph: DataFrame, components: DataFrame) -> DataFrame:
    """``component, path``: a shortest cycle through the smallest node of each component (node, component), from that node back to it.

    Of several, the first in order. All components are searched at once, level by level.
    """
    inner = graph.join(components.select(F.col("node").alias("s"), "component"), "s").join(components.select(F.col("node").alias("t"), F.col("component").alias("_c")), "t")
    inner = stored(inner.where("component = _c").select("component", "s", "t").distinct(), "inner")
    rings, inner = _rings(inner)
    front = components.select("component").distinct().select("component", F.col("component").alias("at"), F.array("component").alias("path"))
    front = front.join(rings.select("component"), "component", "left_anti")
    seen, done = Seen(stored(front.select("component", "at"), "seen")), rings
    while True:
        step = front.withColumnRenamed("at", "s").join(inner, ["component", "s"]).select("component", F.col("t").alias("at"), F.concat("path", F.array("t")).alias("path"))
        step = stored(step.groupBy("component", "at").agg(F.min("path").alias("path")), "step")
        closed = step.where("at = component").select("component", "path")
        done = done.union(closed)
        front = stored(step.join(closed, "component", "left_anti").join(seen.rows(), ["component", "at"], "left_anti"), "front")
        if not front.limit(1).count():
            return done
        seen.add(stored(front.select("component", "at"), "seen"))


def _rings(inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components that are one ring, as ``component, path``, and the edges (component, s, t) of the others.

    Every node of a ring has its distance from the component's node after log n rounds.
    """
    size = inner.groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("s").alias("m"), F.count_distinct("t").alias("k")).where("n = m and n = k").select("component", "n")
    ring = stored(inner.join(size, "component"), "ring")
    longest = ring.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    at = stored(ring.select("component", F.col("s").alias("v"), F.when(F.col("t") != F.col("component"), F.col("t")).alias("to"), F.lit(1).alias("d")), "distance")
    steps = 1
    while steps < longest:
        on = at.select("component", F.col("v").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        new = stored(at.join(on, ["component", "to"], "left").select("component", "v", F.col("to2").alias("to"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")), "distance")
        dropped(at)
        at, steps = new, steps * 2
    # d is now the way from a node to the component's node again
    order = F.expr("transform(array_sort(collect_list(struct(-d, v))), x -> x.v)")
    paths = at.groupBy("component").agg(order.alias("path")).select("component", F.concat("path", F.array("component")).alias("path"))
    return stored(paths, "rings"), inner.join(size.select("component"), "component", "left_anti")


def _shortened(edges: DataFrame, base: DataFrame, ones: DataFrame) -> DataFrame:
    """``u, to, w, b`` of nodes ``ones`` (u) with one edge (a, b, w) out: their value is the larger of b and w plus the value of ``to``.

    Such functions are composed along chains by doubling; ``to`` has none or several edges out.
    """
    at = stored(edges.join(ones.withColumnRenamed("u", "a"), "a").join(base.withColumnRenamed("c", "a"), "a").select(F.col("a").alias("u"), F.col("b").alias("to"), "w", F.col("base").alias("b"), F.lit(True).alias("open")), "chain")
    while at.where("open").limit(1).count():
        on = at.select(F.col("u").alias("to"), F.col("to").alias("to2"), F.col("w").alias("w2"), F.col("b").alias("b2"))
        new = at.join(on, "to", "left").select("u", F.coalesce("to2", "to").alias("to"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.greatest("b", F.coalesce(F.col("w") + F.col("b2"), "b")).alias("b"), F.col("to2").isNotNull().alias("open"))
        new = stored(new, "chain")
        dropped(at)
        at = new
    return at.drop("open")


def chain_lengths(graph: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """``node, depth``: edges of the longest chain from each node of any graph (s, t); on a cyclic component a chain goes round once.

    ``components`` (node, component) are its cyclic ones if they are known already.

    Components become nodes of a graph without cycles. In each round nodes with one
    edge out become functions of the node where their chain branches, composed by
    doubling (larger of a number and another one plus the value there), and edges to them go to that node
    instead. What ends is settled. So a chain or tree of n nodes takes log n joins; where
    nodes have several ways on, a round settles a level. Longest simple paths inside a component
    are not searched; it counts as many edges as it has nodes.
    """
    every = graph.select("s", "t").distinct()
    found = components if components is not None else stored(strong_components(every), "components")
    weight = found.groupBy("component").agg(F.count("*").alias("weight"))
    nodes = every.select(F.col("s").alias("node")).union(every.select("t")).distinct().join(found, "node", "left")
    nodes = stored(nodes.select("node", F.coalesce("component", "node").alias("c")), "nodes")
    weights = stored(nodes.select("c").distinct().join(weight.withColumnRenamed("component", "c"), "c", "left").select("c", F.coalesce("weight", F.lit(0)).cast("long").alias("weight")), "weights")
    ends = every.join(nodes.select(F.col("node").alias("s"), F.col("c").alias("a")), "s").join(nodes.select(F.col("node").alias("t"), F.col("c").alias("b")), "t").where("a <> b").select("a", "b").distinct()
    # the value of a component is the longest way over edges that weigh one and what they lead to
    edges = stored(ends.join(weights.withColumnRenamed("c", "b"), "b").select("a", "b", (F.col("weight") + 1).alias("w")), "dag")
    base = stored(weights.select("c", F.lit(0).cast("long").alias("base")), "base")
    settled, later = [], []
    while base.limit(1).count():
        degree = stored(edges.groupBy("a").agg(F.count("*").alias("n")), "degree")
        ends_here = base.join(degree.withColumnRenamed("a", "c"), "c", "left_anti")
        chain = _shortened(edges, base, degree.where("n = 1").select(F.col("a").alias("u")))
        many = degree.where("n > 1").select("a")
        out = chain.join(many.withColumnRenamed("a", "to"), "to", "left_anti").join(ends_here.withColumnRenamed("c", "to").withColumnRenamed("base", "v"), "to")
        now = stored(ends_here.select("c", F.col("base").alias("value")).union(out.select(F.col("u").alias("c"), F.greatest("b", F.col("w") + F.col("v")).alias("value"))), "settled")
        wait = stored(chain.join(many.withColumnRenamed("a", "to"), "to", "left_semi").select("u", "to", "w", "b"), "waiting")
        settled.append(now)
        later.append(wait)
        open_ = edges.join(many, "a")
        way = open_.join(now.withColumnRenamed("c", "b"), "b", "left").join(wait.select(F.col("u").alias("b"), F.col("to"), F.col("w").alias("w2"), F.col("b").alias("b2")), "b", "left")
        way = stored(way.select("a", F.when(F.col("value").isNull(), F.coalesce("to", "b")).alias("b"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), (F.col("w") + F.coalesce("value", "b2")).alias("base")), "ways")
        more = base.join(many.withColumnRenamed("a", "c"), "c").union(way.where("base is not null").select("a", "base"))
        new_base, new_edges = stored(more.groupBy("c").agg(F.max("base").alias("base")), "base"), stored(way.where("b is not null").groupBy("a", "b").agg(F.max("w").alias("w")), "dag")
        for table in (base, edges, degree, chain, way):
            dropped(table)
        base, edges = new_base, new_edges
    value = reduce(DataFrame.union, settled) if settled else base.select("c", F.col("base").alias("value"))
    for wait in reversed(later):
        if wait.limit(1).count():
            known = wait.join(value.select(F.col("c").alias("to"), "value"), "to").select(F.col("u").alias("c"), F.greatest("b", F.col("w") + F.col("value")).alias("value"))
            value = stored(value.union(known), "values")
    return nodes.join(value, "c").join(weights, "c").select("node", (F.col("weight") + F.col("value")).alias("depth"))


def has_dependency(edges: DataFrame, source: str, target: str) -> bool:
    """Whether ``source`` imports ``target`` directly."""
    return bool(edges_between(edges, source, target).limit(1).count())


def origins(reexports: DataFrame, max_depth: int = 10) -> DataFrame:
    """``barrel, origin``: files behind re-exports (source, target), through other barrels, at most ``max_depth`` deep."""
    links = reexports.select("source", "target").distinct()
    barrels = links.select(F.col("source").alias("target")).distinct()
    front = stored(links.select(F.col("source").alias("barrel"), F.col("target").alias("at")), "origins")
    seen = Seen(front)
    for _ in range(max_depth - 1):
        more = front.join(links, front.at == links.source).select("barrel", F.col("target").alias("at")).distinct()
        front = stored(more.join(seen.rows(), ["barrel", "at"], "left_anti"), "origins")
        if not front.limit(1).count():
            break
        seen.add(front)
    every = seen.rows()
    return every.join(barrels, every.at == barrels.target, "left_anti").select("barrel", F.col("at").alias("origin")).distinct()
