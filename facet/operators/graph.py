"""Graph traversal as hops of edge joins, and the writing and deleting of edges."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_DEPTH = 10  # how far an open range goes


@dataclass(frozen=True)
class Step:
    """One step: edges (from, to, id, …) already filtered, direction (->, <- or <->), depths low to high, and
    a prefix that nodes must have to be expanded by it."""

    edges: DataFrame
    direction: str = "->"
    low: int = 1
    high: int | None = 1
    everything: bool = False
    only: str | None = None


def _hops(step: Step, fields: Sequence[str] | None) -> tuple[DataFrame, list[str], Column]:
    """Edges as (__node, __next, __eid, further columns), both ways for <->; what of it makes up an edge besides __eid; and that edge as a struct.

    Edges are joined by plain columns, each once; they become structs only where they come out.
    """
    e = step.edges
    kept = [c for c in e.columns if fields is None or c == "id" or c in fields]
    own = {c: f"__e{i}" for i, c in enumerate(e.columns) if c in kept and c not in ("id", "from", "to")}
    ends = bool({"from", "to"} & set(kept))

    def way(node: str, after: str) -> DataFrame:
        turned = [F.lit(node == "to").alias("__back")] if ends and step.direction == "<->" else []
        return e.select(F.col(node).alias("__node"), F.col(after).alias("__next"), F.col("id").alias("__eid"), *[F.col(f"`{c}`").alias(n) for c, n in own.items()], *turned)

    out = way("from", "to") if step.direction == "->" else way("to", "from") if step.direction == "<-" else way("from", "to").unionByName(way("to", "from"))
    back = F.col("__back") if "__back" in out.columns else F.lit(step.direction == "<-")
    parts = {"id": F.col("__eid"), "from": F.when(back, F.col("__next")).otherwise(F.col("__node")), "to": F.when(back, F.col("__node")).otherwise(F.col("__next"))}
    whole = F.struct(*[parts.get(c, F.col(own.get(c, c))).alias(c) for c in kept])
    return out, [c for c in out.columns if c not in ("__node", "__next", "__eid") or c == "__node" and ends], whole


def traverse(starts: DataFrame, steps: Sequence[Step], by_edge: bool = False, cut: Callable[[DataFrame], DataFrame] | None = None, fields: Sequence[str] | None = None) -> DataFrame:
    """From each ``start`` (one column) the nodes reached: (start, node, edge id, edge struct, depth).

    By default a node is visited once for each start, at its least depth; the start itself never comes
    out, nor do nodes passed on the way to a longer path (with ``by_edge`` edges come out, once each).
    With ``everything`` each path counts.  ``cut`` (say, a checkpoint) is applied to the visited set of each
    hop beyond the second, so that plans stay small.  ``fields`` are the columns of the edges that are wanted
    besides their id; others are not moved.

    The first hop joins, leaves out and gathers by ``start`` alone, so its edges are shuffled once.
    """
    levels: list[tuple[Step, int, bool]] = []
    for i, s in enumerate(steps):
        most = s.high if s.high is not None else OPEN_DEPTH
        levels += [(s, d, i == len(steps) - 1) for d in range(1, most + 1)]
    everything = any(s.everything for s in steps)
    frontier = starts.select("start").distinct()
    visited = frontier.select("start", F.col("start").alias("__key"))
    out = None
    for k, (step, depth, last) in enumerate(levels):
        at = "__at" if k else "start"
        f = frontier.where(F.col(at).startswith(step.only)) if step.only and depth == 1 else frontier
        emits = last and depth >= step.low
        hops, rest, whole = _hops(step, fields if emits else ())
        reached = f.join(hops, f[at] == F.col("__node")).select("start", "__next", "__eid", *rest)
        key = F.col("__eid") if emits and by_edge else F.col("__next")
        more = k + 1 < len(levels)
        if everything:
            new = reached
        else:
            # before the first hop only the start itself has been visited
            new = reached.withColumn("__key", key)
            new = new.join(visited, ["start", "__key"], "left_anti") if k else new.where(~F.col("__key").eqNullSafe(F.col("start")))
            named = "__eid" if emits and by_edge else "__next"
            pick = F.min_by(F.struct(*[c for c in ("__next", "__eid", *rest) if c != named]), F.col("__eid")).alias("p")
            new = new.groupBy("start", "__key").agg(pick).select("start", "__key", F.col("__key").alias(named), "p.*")
        if not everything and more:
            if cut is not None and k:
                new = cut(new)
            visited = visited.unionByName(new.select("start", "__key"))
        if emits:
            found = new.select("start", F.col("__next").alias("node"), F.col("__eid").alias("edge_id"), whole.alias("edge"), F.lit(k + 1).alias("depth"))
            out = found if out is None else out.unionByName(found, allowMissingColumns=True)
        if more:
            frontier = new.select("start", F.col("__next").alias("__at"))
            if not everything:
                frontier = frontier.distinct()
            if emits and depth == (step.high if step.high is not None else OPEN_DEPTH):
                break
    return out


def related(sources: DataFrame, targets: DataFrame, label: str, fields: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """New edges from every source to every target (each a column ``id``): the pairs asked for are the result.

    An edge's id is a hash of its ends, so that writing is repeatable.
    """
    a, b = sources.select(F.col("id").alias("from")).distinct(), targets.select(F.col("id").alias("to")).distinct()
    name = F.concat(F.lit(label + ":"), F.substring(F.sha2(F.concat_ws("|", F.lit(label), "from", "to"), 256), 1, 21))
    return a.crossJoin(b).select(name.alias("id"), "from", "to", *[c.alias(n) for n, c in fields])


def with_edges(old: DataFrame, new: DataFrame, single: bool = True) -> DataFrame:
    """Old and new edges; of a single-cardinality kind a new one replaces the old one between the same nodes."""
    kept = old.join(new.select("from", "to"), ["from", "to"], "left_anti") if single else old
    return kept.unionByName(new, allowMissingColumns=True)


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes (column ``id``) that are gone."""
    g = gone.select("id").distinct()
    return edges.join(g.withColumnRenamed("id", "from"), "from", "left_anti").join(g.withColumnRenamed("id", "to"), "to", "left_anti").select(*edges.columns)


def touching(edges: Sequence[DataFrame], nodes: DataFrame) -> DataFrame:
    """Edges that touch one of the nodes."""
    n = nodes.select("id").distinct()
    ends = reduce(DataFrame.unionByName, [e.select("id", "from", "to") for e in edges])
    return ends.join(n.withColumnRenamed("id", "from"), "from", "left_semi").unionByName(ends.join(n.withColumnRenamed("id", "to"), "to", "left_semi")).distinct()


def list_edges(edges: DataFrame, node: str, out: bool = True, limit: int = 1000, after: str | None = None) -> DataFrame:
    """A page of a node's edges in the order of their far ends; ``after`` is the last far end of the page before."""
    near, far = ("from", "to") if out else ("to", "from")
    d = edges.where(F.col(near) == node)
    d = d.where(F.col(far) > after) if after is not None else d
    return d.orderBy(far, "id").limit(max(1, min(1000, limit)))
