"""SELECT statements to DataFrame plans.

References become left joins (one for each path, however often used), IN subqueries semi and anti joins, correlated
subqueries an aggregation by the outer values they use plus a left join, traversals hops of edge joins.
The rest is expressions, so that Catalyst sees one declarative plan.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..catalog import HAS, Catalog, settled
from ..functions import registry
from ..functions import values as V
from ..functions.values import E, LanguageError
from ..lang.tree import Node, rewrite, walk
from ..operators import graph, search

AGGREGATES = ("count", "sum", "avg", "min", "max")
_fresh = itertools.count()
Refs = dict[tuple[str, ...], frozenset[str]]


def fresh(kind: str) -> str:
    return f"__{kind}{next(_fresh)}"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Scope:
    """The rows that expressions are compiled against."""

    df: DataFrame
    refs: Refs = field(default_factory=dict)
    scalar: bool = False  # rows are values, in the column ``value``
    parents: dict[tuple[int, tuple[str, ...]], str] = field(default_factory=dict)  # correlated values, by level and path
    names: dict[str, str] = field(default_factory=dict)  # columns that stand for aliases
    collection: str | None = None

    def types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields}

    def visible(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__") and not c.startswith("$")]


@dataclass
class Rows:
    """A planned SELECT: its columns in order (``keys`` first, hidden), and whether it yields values."""

    df: DataFrame
    columns: list[str]
    refs: Refs
    scalar: bool
    keys: list[str]
    order: str | None = None  # a hidden column that numbers the rows
    lone: list[Any] | None = None  # of an aggregate without groups: the value of each column over no rows


@dataclass
class Table:
    """A variable that holds rows."""

    rows: Rows


def is_aggregate(n: Node) -> bool:
    return n.kind == "call" and n.name in AGGREGATES and n.space != "math"


def has_aggregate(n: Node) -> bool:
    return any(is_aggregate(x) for x in walk(n, lambda y: y.kind not in ("subquery", "in_query")))


def display(n: Node, text: str) -> str:
    """The default name of an item."""
    if n.kind == "field":
        return ".".join(n.path)
    if n.kind == "call":
        args = "*" if n.star else ", ".join(display(a, a.kind) for a in n.args)
        name = n.name if is_aggregate(n) or n.space is None else f"{n.space}::{n.name}"
        return f"{name}({args})"
    if n.kind == "constant":
        return f"{n.space}::{n.name}"
    return " ".join(text.split())


def parent_uses(n: Any, level: int = 1) -> set[tuple[int, tuple[str, ...]]]:
    """(level, path) of what ``n``, at ``level`` subqueries deep, takes from outside; level 1 is the nearest outside."""
    out = set()
    for x in walk(n, lambda y: y.kind not in ("subquery", "in_query")):
        if x.kind == "parent" and x.levels >= level:
            out.add((x.levels - level + 1, tuple(x.path)))
        elif x.kind in ("subquery", "in_query"):
            out |= parent_uses(x.query, level + 1)
            if x.kind == "in_query":
                out |= parent_uses(x.value, level)
    return out


class Planner:
    def __init__(self, catalog: Catalog, variables: dict[str, Any] | None = None):
        self.catalog = catalog
        self.spark = catalog.spark
        self.variables = variables if variables is not None else {}

    # ---- expressions

    def compile(self, n: Node, s: Scope) -> E:
        """A prepared expression (see ``prepare``) as a column."""
        k = n.kind
        if k == "column":
            return E(quoted(n.name), s.types()[n.name])
        if k == "literal":
            return V.literal(n.value)
        if k == "duration":
            return V.duration(n.nanos)
        if k == "reference":
            return V.literal(n.value)
        if k == "field":
            return self.field(n.path, s)
        if k == "value":
            if not s.scalar:
                e = V.obj([(c, E(quoted(c), s.types()[c])) for c in s.visible()]) if not n.path else self.field(n.path, s)
                return e
            e = E(quoted("value"), s.types()["value"])
            for p in n.path:
                e = V.field(e, p)
            return e
        if k == "parent":
            name = s.parents.get((n.levels, tuple(n.path)))
            if name is None:
                raise LanguageError(f"$parent.{'.'.join(n.path)} outside a subquery")
            return E(quoted(name), s.types()[name])
        if k == "variable":
            if n.name not in self.variables:
                raise LanguageError(f"undefined variable ${n.name}")
            return V.literal(self.variables[n.name])
        if k == "constant":
            return registry.constant(f"{n.space}::{n.name}")
        if k == "binary":
            a, b = self.compile(n.left, s), self.compile(n.right, s)
            if n.op in ("AND", "OR"):
                return V.logic(n.op, a, b)
            return V.compare(n.op, a, b) if n.op in ("=", "!=", "<", "<=", ">", ">=") else V.arithmetic(n.op, a, b)
        if k == "not":
            return V.negate(self.compile(n.value, s))
        if k == "negative":
            return V.minus(self.compile(n.value, s))
        if k == "is_null":
            e = self.compile(n.value, s)
            c = e.col.isNull() | F.coalesce(F.is_variant_null(e.col), F.lit(True)) if isinstance(e.type, T.VariantType) else e.col.isNull()
            return E(~c if n.no else c, V.BOOL)
        if k == "is_none":
            c = self.missing(n.value, s)
            return E(~c if n.no else c, V.BOOL)
        if k == "in_list":
            return V.member(self.compile(n.value, s), [self.compile(i, s) for i in n.items], n.no)
        if k == "in_value":
            return V.inside(self.compile(n.value, s), self.compile(n.target, s), n.no)
        if k == "coalesce":
            a, b = self.compile(n.left, s), self.compile(n.right, s)
            t = V.common([a.type, b.type])
            if t is None:
                t = V.STRING
            return E(F.when(V.truthy(a), V.widened(a, t)).otherwise(V.widened(b, t)), t)
        if k == "index":
            return V.index(self.compile(n.value, s), self.compile(n.at, s))
        if k == "slice":
            return V.cut(self.compile(n.value, s), n.start and self.compile(n.start, s), n.end and self.compile(n.end, s))
        if k == "access":
            return V.field(self.compile(n.value, s), n.name)
        if k == "object":
            return V.obj([(name, self.compile(v, s)) for name, v in n.items])
        if k == "array":
            return V.array([self.compile(v, s) for v in n.items])
        if k == "call":
            return self.call(n, s)
        if k == "full_text" or k == "nearest":
            raise LanguageError("search operators belong to the conjuncts of WHERE")
        if k in ("if", "for", "break", "continue"):
            raise LanguageError(f"{k.upper()} is a statement, not part of an expression")
        raise LanguageError(f"unexpected {k}")

    def field(self, path: list[str], s: Scope) -> E:
        types = s.types()
        name = s.names.get(path[0], path[0])
        if name not in types:
            if s.scalar and "value" in types:
                e = E(quoted("value"), types["value"])
                for p in path:
                    e = V.field(e, p)
                return e
            return V.literal(None)
        e = E(quoted(name), types[name])
        for p in path[1:]:
            e = V.field(e, p)
        return e

    def missing(self, n: Node, s: Scope) -> Column:
        if n.kind != "field":
            return F.lit(False)
        types = s.types()
        if n.path[0] not in types:
            return F.lit(True)
        gone = ~F.array_contains(quoted(HAS), n.path[0]) if HAS in types else F.lit(False)
        t = types[n.path[0]]
        for i, p in enumerate(n.path[1:], 1):
            if not isinstance(t, T.StructType) or p not in t.names:
                return F.lit(True)
            t = t[p].dataType
            gone = gone | self.field(n.path[:i], s).col.isNull()
        return F.coalesce(gone, F.lit(False))

    def call(self, n: Node, s: Scope) -> E:
        if is_aggregate(n):
            if n.args and n.args[0].kind == "traverse":
                raise LanguageError("COUNT counts rows; use array::length(->…) for what a traversal reaches")
            raise LanguageError(f"{n.name.upper()} is an aggregate and has no place here")
        if n.space is None:
            raise LanguageError(f"unknown function {n.name}; functions are written namespace::{n.name}")
        name = f"{n.space}::{n.name}"
        if name == "search::rrf":
            raise LanguageError("search::rrf is a source: FROM search::rrf([…], limit)")
        args = [self.compile(a, s) for a in n.args]
        if name == "fts::score" and "$score" in s.df.columns:
            label = n.args[0].value if n.args else None
            column = f"$score_{label}" if label else "$score"
            if column not in s.df.columns:
                raise LanguageError(f"no full-text search is named {label}")
            return E(quoted(column), V.DOUBLE)
        if name in ("fts::score", "vector::distance") and ("$score" if name[0] == "f" else "$distance") not in s.df.columns:
            return E(F.lit(None).cast(V.DOUBLE), V.DOUBLE)
        if name in ("type::is_reference", "type::of", "type::is_string") and n.args[0].kind in ("field", "reference"):
            if n.args[0].kind == "reference" or tuple(n.args[0].path) in s.refs:
                c = args[0].col
                if name == "type::of":
                    return E(F.when(c.isNull(), "null").otherwise("reference"), V.STRING)
                return E(c.isNotNull() & F.lit(name.endswith("reference")), V.BOOL)
        return registry.call(name, args)

    # ---- preparing

    def prepare(self, nodes: list[Node], s: Scope) -> list[Node]:
        """Bring what expressions need from elsewhere into the rows of ``s``; returns the expressions over those."""
        return [rewrite(n, lambda x: self._bring(x, s)) for n in nodes]

    def _bring(self, x: Node, s: Scope) -> Node | None:
        if x.kind == "field" and len(x.path) > 1:
            return self._deref(x.path, s)
        if x.kind == "index" and x.value.kind == "subquery" and x.at == Node("literal", value=0) and x.value.query.limit is None and not parent_uses(x.value.query):
            first = Node("select", **{**x.value.query.parts, "limit": 1})
            return Node("index", value=self._subquery(first, s), at=x.at)
        if x.kind == "parent" and (x.levels, tuple(x.path)) in s.parents:
            return Node("column", name=s.parents[x.levels, tuple(x.path)])
        if x.kind == "subquery":
            return self._subquery(x.query, s)
        if x.kind == "in_query":
            (value,) = self.prepare([x.value], s)
            return self._in_query(value, x, s)
        if x.kind == "traverse":
            return Node("column", name=self.traversal(x, s))
        if x.kind == "variable" and isinstance(self.variables.get(x.name), Table):
            return Node("column", name=self._whole(self.variables[x.name].rows, s))
        if x.kind == "in_value" and x.target.kind == "variable" and isinstance(self.variables.get(x.target.name), Table):
            (value,) = self.prepare([x.value], s)
            rows = self.variables[x.target.name].rows
            first = next((c for c in rows.columns if c != "id"), rows.columns[0])
            return self._member_of(value, rows.df.select(quoted(first).alias("v")), x.no, s)
        return None

    def _deref(self, path: list[str], s: Scope, whole: bool = False) -> Node | None:
        """Joins for each reference along a path; the path over the joined columns."""
        done: list[str] = []
        rest = list(path)
        head: list[str] = []  # the path in terms of columns
        changed = False
        while rest:
            done.append(rest.pop(0))
            head.append(done[-1])
            to = s.refs.get(tuple(done))
            if to is None or not (rest or whole):
                continue
            name = "__ref_" + "/".join(done)
            if name not in s.df.columns:
                ref = self.field(head, s)
                if isinstance(ref.type, T.ArrayType):
                    s.df = self._joined_array(s.df, ref, to, name)
                else:
                    s.df = self._joined(s.df, ref.col, to, name)
                for c in to:
                    for p, target in self.catalog.collection(c).refs.items():
                        s.refs.setdefault((*done, *p), target)
            head = [name]
            changed = True
        return Node("field", path=head) if changed else None

    def _targets(self, to: frozenset[str], name: str) -> DataFrame:
        side = None
        for c in sorted(to):
            df = self.catalog.collection(c).df
            own = df.select(F.col("id").alias("__key"), F.struct(*[quoted(x) for x in df.columns if not x.startswith("__")]).alias(name))
            side = own if side is None else side.unionByName(own) if side.schema == own.schema else _union_structs(side, own, name)
        return side

    def _joined(self, df: DataFrame, ref: Column, to: frozenset[str], name: str) -> DataFrame:
        side = self._targets(to, name)
        return df.join(side, ref == side["__key"], "left").drop("__key")

    def _joined_array(self, df: DataFrame, ref: E, to: frozenset[str], name: str) -> DataFrame:
        """Arrays of references to arrays of the documents, in order; of a missing one, null."""
        side = self._targets(to, name)
        arrays = df.select(ref.col.alias("__arr")).where(F.col("__arr").isNotNull()).distinct()
        each = arrays.select("__arr", F.posexplode("__arr").alias("__p", "__r"))
        got = each.join(side, each["__r"] == side["__key"], "left").groupBy("__arr").agg(F.array_sort(F.collect_list(F.struct("__p", name))).alias("__l"))
        got = got.select(F.col("__arr"), F.transform("__l", lambda x: x[name]).alias(name))
        return df.join(got, ref.col == got["__arr"], "left").drop("__arr")

    def _in_query(self, value: Node, x: Node, s: Scope) -> Node:
        if parent_uses(x.query):
            arr = self._subquery(Node(**{**x.query.parts, "kind": "select", "value": True, "items": [self._first_item(x.query)]}), s)
            return Node("in_value", value=value, target=arr, no=x.no)
        rows = self.select(x.query)
        first = rows.columns[0] if rows.scalar else next((c for c in rows.columns if c != "id"), rows.columns[0])
        return self._member_of(value, rows.df.select(quoted(first).alias("v")), x.no, s)

    @staticmethod
    def _first_item(q: Node) -> Node:
        return next((i for i in q.items if not (i.kind == "item" and i.value == Node("field", path=["id"]))), q.items[0])

    def _member_of(self, value: Node, side: DataFrame, no: bool, s: Scope) -> Node:
        """A column that tells, three-valued, whether the value is in ``side``."""
        view, name, key = fresh("in").strip("_"), fresh("is"), fresh("v")
        side.createOrReplaceTempView(view)
        s.df = s.df.withColumn(key, self.compile(value, s).col)
        s.df = s.df.select("*", F.expr(f"`{key}` {'NOT ' if no else ''}IN (SELECT v FROM {view})").alias(name)).drop(key)
        return Node("column", name=name)

    def semi(self, df: DataFrame, value: E, side: DataFrame, no: bool) -> DataFrame:
        """Rows whose value is (not) in ``side``: a semi join, or a null-aware anti join."""
        key, view = fresh("v"), fresh("in").strip("_")
        side.createOrReplaceTempView(view)
        return df.withColumn(key, value.col).where(F.expr(f"`{key}` {'NOT ' if no else ''}IN (SELECT v FROM {view})")).drop(key)

    def _whole(self, rows: Rows, s: Scope) -> str:
        """A column with all of some rows, as an array (a value that every row sees)."""
        name = fresh("all")
        s.df = s.df.crossJoin(self._array(rows, [], name))  # one row, however large: no hint to broadcast it
        return name

    def _array(self, rows: Rows, keys: list[str], name: str) -> DataFrame:
        item = quoted(rows.columns[0]) if rows.scalar else F.struct(*[quoted(c) for c in rows.columns])
        if rows.order:
            listed = F.transform(F.array_sort(F.collect_list(F.struct(quoted(rows.order).alias("o"), item.alias("i")))), lambda x: x["i"])
        elif rows.scalar:
            listed = F.transform(F.collect_list(F.struct(item.alias("i"))), lambda x: x["i"])
        else:
            listed = F.collect_list(item)
        return rows.df.groupBy(*keys).agg(listed.alias(name)) if keys else rows.df.agg(listed.alias(name))

    def _subquery(self, q: Node, s: Scope) -> Node:
        name = fresh("sub")
        uses = sorted(parent_uses(q))
        if not uses:
            return Node("column", name=self._whole(self.select(q), s))
        keys: dict[tuple[int, tuple[str, ...]], str] = {}
        for level, path in uses:
            n = Node("field", path=list(path)) if level == 1 else Node("parent", levels=level - 1, path=list(path))
            (n,) = self.prepare([n], s)
            e = self.compile(n, s)
            keys[level, path] = fresh("k")
            s.df = s.df.withColumn(keys[level, path], e.col)
        given = s.df.select(*keys.values()).distinct()
        rows = self.select(q, given, keys, s)
        got = self._array(rows, list(keys.values()), name)
        t = got.schema[name].dataType
        cond = None
        renamed = got
        for k in keys.values():
            renamed = renamed.withColumnRenamed(k, k + "_")
            c = s.df[k].eqNullSafe(renamed[k + "_"])
            cond = c if cond is None else cond & c
        s.df = s.df.join(renamed, cond, "left").drop(*[k + "_" for k in keys.values()])
        empty = F.array().cast(t)
        if rows.lone is not None:  # an aggregate without groups has a row even over none
            inner = t.elementType
            if rows.scalar:
                empty = F.array(F.lit(rows.lone[0]).cast(inner))
            else:
                empty = F.array(F.struct(*[F.lit(v).cast(inner[c].dataType).alias(c) for c, v in zip(rows.columns, rows.lone)]))
        s.df = s.df.withColumn(name, F.coalesce(F.col(name), empty))
        return Node("column", name=name)

    # ---- traversal

    def _edges(self, step: Node) -> DataFrame | None:
        labels = sorted(self.catalog.edges) if step.label == "*" else [step.label]
        out = None
        for label in labels:
            kind = self.catalog.edges.get(label)
            if kind is None:
                continue
            df = kind.df
            if step.where is not None:
                s = Scope(df)
                (w,) = self.prepare([step.where], s)
                df = s.df.where(V.truthy(self.compile(w, s))).select(*[quoted(c) for c in df.columns])
            if not kind.directed:
                back = df.select(*[(F.col({"from": "to", "to": "from"}.get(c, c)) if c in ("from", "to") else quoted(c)).alias(c) for c in df.columns])
                df = df.unionByName(back).dropDuplicates(["id", "from", "to"])
            if step.label == "*":
                df = df.select("id", "from", "to", F.lit(label).alias("label"))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def traversal(self, t: Node, s: Scope) -> str:
        """A column with what a traversal reaches from each row's id, as an array of objects (or of values of one field)."""
        name = fresh("walk")
        steps = list(t.steps)
        target, target_fields = None, None
        only: str | None = None
        plan: list[graph.Step] = []
        for i, st in enumerate(steps):
            last = i == len(steps) - 1
            if st.label != "*" and st.label not in self.catalog.edges:
                if st.label in self.catalog.collections and i:
                    if last:
                        target, target_fields = st.label, st.fields
                    else:
                        only = st.label + ":"
                    continue
                empty = F.array().cast("array<struct<id:string>>")
                s.df = s.df.withColumn(name, empty)
                return name
            if st.label in self.catalog.collections and last and i:
                target, target_fields = st.label, st.fields
                continue
            df = self._edges(st)
            if df is None:
                s.df = s.df.withColumn(name, F.array().cast("array<struct<id:string>>"))
                return name
            plan.append(graph.Step(df, st.direction, st.low, st.high, st.everything, only))
            only = None
        if not plan:
            raise LanguageError("a traversal needs an edge label")
        by_edge = target is None
        edge_fields = next((st.fields for st in reversed(steps) if st.label in self.catalog.edges or st.label == "*"), None) if by_edge else None
        if "id" not in s.df.columns:
            raise LanguageError("a traversal starts from documents")
        starts = s.df.select(F.col("id").alias("start")).where(F.col("id").isNotNull()).distinct()
        found = graph.traverse(starts, plan, by_edge, settled, self._edge_columns(plan[-1].edges, edge_fields) if by_edge else ())
        if by_edge:
            label = [st.label for st in steps if st.label in self.catalog.edges or st.label == "*"][-1]
            rows = self._edge_items(found, edge_fields, sorted(self.catalog.edges) if label == "*" else [label])
        else:
            rows = self._node_items(found, target_fields, target, name)
        got = rows.groupBy("start").agg(F.collect_list("item").alias(name))
        s.df = s.df.join(got, s.df["id"] == got["start"], "left").drop("start").withColumn(name, F.coalesce(F.col(name), F.array().cast(got.schema[name].dataType)))
        return name

    def _edge_columns(self, edges: DataFrame, fields: Any) -> list[str] | None:
        """The columns that the fields taken from edges need, None for all."""
        if fields is None or fields == "*":
            return None
        heads = {p[0].lower() for _, p in fields}
        return [c for c in edges.columns if c.lower() in heads or c.startswith("__")]

    def _edge_items(self, found: DataFrame, fields: Any, labels: list[str]) -> DataFrame:
        if fields is None or fields == "*":
            return found.select("start", F.col("edge").alias("item"))
        s = Scope(found.select("start", "edge.*"))
        for end in ("from", "to"):
            s.refs[(end,)] = frozenset(self.catalog.collections)
        need = [p for _, p in fields]
        known = [self.catalog.edges[x] for x in labels]
        declared = all(k.ends is not None for k in known)

        def ends(end: str, all_: frozenset[str]) -> frozenset[str]:
            if not declared:
                return self._ends(found, end, all_)
            sides = {"from": {0}, "to": {1}}
            return frozenset().union(*(k.ends[i] for k in known for i in (sides[end] if k.directed else {0, 1})))

        s.refs = {k: ends(k[0], v) for k, v in s.refs.items() if any(p[0] == k[0] and len(p) > 1 for p in need)}
        nodes = self.prepare([Node("field", path=list(p)) for p in need], s)
        items = [("id", E(F.col("id"), V.STRING))] + [(a, self.compile(n, s)) for (a, _), n in zip(fields, nodes)]
        return s.df.select("start", V.obj(items).col.alias("item"))

    def _ends(self, found: DataFrame, end: str, all_: frozenset[str]) -> frozenset[str]:
        """The collections that an end of the found edges refers to; a job, for kinds of edges whose ends aren't declared."""
        got = found.select(F.substring_index(F.col("edge").getField(end), ":", 1).alias("c")).where(F.col("c").isin(*sorted(all_))).distinct().collect()
        return frozenset(r["c"] for r in got) or all_

    def _node_items(self, found: DataFrame, fields: Any, target: str, name: str) -> DataFrame:
        df = found.select("start", F.col("node").alias("id"))
        if fields is None:
            return df.select("start", F.struct("id").alias("item"))
        own = self.catalog.collection(target)
        docs = own.df.select(*[quoted(c) for c in own.df.columns if not c.startswith("__")])
        s = Scope(df.join(docs, "id", "left"), dict(own.refs), collection=target)
        if fields == "*":
            return s.df.select("start", F.struct(*[quoted(c) for c in docs.columns]).alias("item"))
        nodes = self.prepare([Node("field", path=list(p)) for _, p in fields], s)
        items = [("id", E(F.col("id"), V.STRING))] + [(a, self.compile(n, s)) for (a, _), n in zip(fields, nodes)]
        return s.df.select("start", V.obj(items).col.alias("item"))

    # ---- sources

    def source(self, n: Node | None, given: DataFrame | None, parents: dict, outer: Scope | None) -> Scope:
        """The rows of FROM; ``given`` has the correlated values, which each row carries on."""
        if n is None:
            s = Scope(self.spark.range(1).select(F.lit(None).cast("string").alias("__none")))
        elif n.kind == "from_collection":
            s = self._collection(n)
        elif n.kind == "from_query":
            if parent_uses(n.query):
                rows = self.select(n.query, given, parents, outer)
                return Scope(rows.df, rows.refs, rows.scalar, parents)
            rows = self.select(n.query)
            s = Scope(rows.df.select(*[quoted(c) for c in rows.columns], *([quoted(rows.order)] if rows.order else [])), rows.refs, rows.scalar)
        elif n.kind == "from_range":
            lo, hi = self.constant(n.low), self.constant(n.high)
            if not all(isinstance(v, int) and not isinstance(v, bool) for v in (lo, hi)):
                raise LanguageError("the bounds of a range are integers")
            s = Scope(self.spark.range(lo, max(hi + 1, lo)).select(F.col("id").alias("value")), scalar=True)
        else:
            s = self._value_source(n.value, given, parents)
            if s.parents:
                return s
        if given is not None:
            s.df = s.df.crossJoin(given)  # the join's condition is in WHERE; Catalyst moves it in
            s.parents = parents
        return s

    def _collection(self, n: Node) -> Scope:
        c = self.catalog.collection(n.collection)
        df = c.df
        if n.key is not None:
            df = df.where(F.col("id") == f"{n.collection}:{n.key}")
            if c.key is not None:  # reaches the scan, as the computed id does not
                df = df.where(F.col(c.key) == F.lit(n.key).try_cast(df.schema[c.key].dataType))
        s = Scope(df, dict(c.refs), collection=n.collection)
        if not n.path and not n.posts:
            return s
        e = Node("field", path=n.path) if n.path else Node("field", path=["id"])
        for kind, *args in n.posts:
            e = Node("index", value=e, at=args[0]) if kind == "index" else Node("slice", value=e, start=args[0], end=args[1])
        (e,) = self.prepare([e], s)
        if n.key is not None and not df.limit(1).count():
            raise LanguageError(f"document {n.collection}:{n.key} does not exist")
        return self._expanded(s.df, self.compile(e, s), [])

    def _expanded(self, df: DataFrame, e: E, keep: list[str]) -> Scope:
        """A value as rows: an array's elements, an object as itself, null as none, anything else as one value."""
        t = e.type
        kept = [quoted(k) for k in keep]
        if V.is_null(t):
            return Scope(df.where(F.lit(False)).select(*kept, F.lit(None).alias("value")), scalar=True)
        if isinstance(t, T.ArrayType):
            d = df.select(*kept, F.posexplode(e.col).alias("__o", "value"))
            if isinstance(t.elementType, T.StructType):
                names = [c for c in t.elementType.names if c != "_"]
                return Scope(d.select(*kept, "__o", *[F.col("value").getField(c).alias(c) for c in names]))
            return Scope(d, scalar=True)
        d = df.where(e.col.isNotNull())
        if isinstance(t, T.StructType):
            return Scope(d.select(*kept, *[e.col.getField(c).alias(c) for c in t.names]))
        return Scope(d.select(*kept, e.col.alias("value")), scalar=True)

    def _value_source(self, v: Node, given: DataFrame | None, parents: dict) -> Scope:
        if v.kind == "call" and v.space == "search" and v.name == "rrf":
            return self._fusion(v)
        if v.kind == "variable" and isinstance(self.variables.get(v.name), Table):
            rows = self.variables[v.name].rows
            return Scope(rows.df.select(*[quoted(c) for c in rows.columns], *([quoted(rows.order)] if rows.order else [])), rows.refs, rows.scalar)
        if given is not None and parent_uses(v):
            s = Scope(given, parents=parents)
            (v2,) = self.prepare([v], s)
            e = self.compile(v2, s)
            out = self._expanded(s.df, e, list(parents.values()))
            if out.scalar and isinstance(e.type, T.StringType):  # a reference: its document
                found = self._reference_rows(out.df, parents)
                out = found or out
            out.parents = parents
            return out
        s = Scope(self.spark.range(1).select(F.lit(None).cast("string").alias("__none")))
        (v2,) = self.prepare([v], s)
        return self._expanded(s.df, self.compile(v2, s), [])

    def _reference_rows(self, df: DataFrame, parents: dict) -> Scope | None:
        got = df.select(F.substring_index("value", ":", 1).alias("c")).distinct().limit(2).collect()
        if len(got) != 1 or got[0]["c"] not in self.catalog.collections:
            return None
        c = self.catalog.collection(got[0]["c"])
        return Scope(df.join(c.df, F.col("value") == c.df["id"]).drop("value"), dict(c.refs), collection=c.name)

    def _fusion(self, v: Node) -> Scope:
        if len(v.args) not in (2, 3) or v.args[0].kind != "array":
            raise LanguageError("search::rrf takes an array of lists, a limit and, if wanted, k")
        lists = []
        for item in v.args[0].items:
            if item.kind == "subquery":
                rows = self.select(item.query)
            elif item.kind == "variable" and isinstance(self.variables.get(item.name), Table):
                rows = self.variables[item.name].rows
            else:
                raise LanguageError("the lists of search::rrf are subqueries or variables that hold rows")
            if "id" not in rows.columns:
                raise LanguageError("the lists of search::rrf need ids")
            lists.append((rows.df.select(*[quoted(c) for c in rows.columns], *([quoted(rows.order).alias("__ord")] if rows.order else [])), [F.col("__ord")] if rows.order else [F.col("id")]))
        limit, k = self.constant(v.args[1]), self.constant(v.args[2]) if len(v.args) > 2 else 60
        plain = [(d, o) for d, o in lists]
        df = search.rrf([(d, o) for d, o in plain], limit, k).drop("__ord")
        return Scope(df.withColumn("__o", F.row_number().over(Window.orderBy(F.desc("_rrf_score"), "id"))))

    def constant(self, n: Node) -> Any:
        """The value of an expression that needs no rows."""
        if n.kind == "literal":
            return n.value
        if n.kind == "variable" and n.name in self.variables and not isinstance(self.variables[n.name], Table):
            return self.variables[n.name]
        rows = self.select(Node("select", distinct=False, value=True, items=[Node("item", value=n, alias=None, text="")], source=None, where=None, group=[], order=[], limit=None, offset=None, fetch=[]))
        got = rows.df.select(quoted(rows.columns[0])).collect()
        return python(got[0][0]) if got else None

    # ---- select

    def select(self, q: Node, given: DataFrame | None = None, parents: dict | None = None, outer: Scope | None = None) -> Rows:
        """Plan a SELECT; with ``given``, once for each of its rows (the correlated values, in ``parents``)."""
        parents = parents or {}
        s = self.source(q.source, given, parents, outer)
        keys = list(parents.values())
        base_order = next((c for c in s.df.columns if c == "__o" or c.startswith("__row")), None)
        if q.where is not None:
            self.where(q.where, s)
        items = self._items(q, s)
        grouped = bool(q.group) or any(has_aggregate(n) for _, n in items)
        order = list(q.order)
        lone = None
        if grouped:
            if q.items and q.items[0].kind == "star":
                raise LanguageError("* does not go with aggregates")
            s, items, order, lone = self._grouped(q, s, items, order, keys)
            base_order = None
        aliases = {a for a, _ in items}
        plain = [n for _, n in items]
        ordered = []
        for n, desc in order:
            if n.kind == "field" and len(n.path) == 1 and n.path[0] in aliases:
                n = dict(items)[n.path[0]]
            ordered.append((n, desc))
        prepared = self.prepare([*plain, *[n for n, _ in ordered]], s)
        plain, ordered = prepared[: len(plain)], [(n, d) for n, (_, d) in zip(prepared[len(plain) :], ordered)]
        columns, refs = [], {}
        df = s.df
        outs: dict[str, E] = {}
        for (name, original), n in zip(items, plain):
            outs[name] = self.compile(n, s)
            columns.append(name)
            if original.kind == "field":
                for path, to in s.refs.items():
                    p = tuple(original.path)
                    if path[: len(p)] == p:
                        refs[(name, *path[len(p) :])] = to
        implied = not grouped and not q.value and "id" in s.df.columns and "id" not in columns and not s.scalar
        hidden = [fresh("s") for _ in ordered]
        sort_columns = [V.sort_key(self.compile(n, s)).alias(h) for (n, _), h in zip(ordered, hidden)]
        if implied and not q.distinct:
            columns = ["id", *columns]
            outs["id"] = E(F.col("id"), V.STRING)
        extra = [quoted(base_order).alias("__base")] if base_order else []
        scores = [F.col("`$score`")] if "$score" in df.columns else []
        near = [F.col("`$distance`")] if "$distance" in df.columns else []
        ident = [F.col("id").alias("__id")] if "id" in df.columns else []
        df = df.select(*[quoted(k) for k in keys], *[outs[c].col.alias(c) for c in columns], *sort_columns, *extra, *scores, *near, *ident)
        if q.distinct:
            helpers = [c for c in df.columns if c not in columns and c not in keys]
            first = F.min(F.struct(*([quoted("__id")] if ident else []), *[quoted(c) for c in helpers if c != "__id"])).alias("__f") if helpers else None
            g = df.groupBy(*[quoted(c) for c in [*keys, *columns]])
            df = g.agg(first).select(*[quoted(c) for c in [*keys, *columns]], "__f.*") if first is not None else g.agg(F.lit(1).alias("__n")).drop("__n")
            if implied and ident:
                df = df.withColumn("id", quoted("__id"))
                columns = ["id", *columns]
        by: list[Column] = [F.col(f"`{h}`").desc() if d else F.col(f"`{h}`").asc() for h, (_, d) in zip(hidden, ordered)]
        if not by and near:
            by = [F.col("`$distance`").asc()]
        elif not by and scores:
            by = [F.col("`$score`").desc()]
        elif not by and base_order:
            by = [F.col("__base").asc()]
        if by and ident and "__id" in df.columns:
            by.append(F.col("__id").asc())
        number = None
        if keys:
            if q.limit is not None or q.offset is not None or by:
                number = fresh("row")
                w = Window.partitionBy(*keys).orderBy(*(by or [F.lit(0)]))
                df = df.withColumn(number, F.row_number().over(w))
                lo = q.offset or 0
                if q.offset:
                    df = df.where(F.col(number) > lo)
                if q.limit is not None:
                    df = df.where(F.col(number) <= lo + q.limit)
        else:
            df = df.orderBy(*by) if by else df
            df = df.offset(q.offset) if q.offset else df
            df = df.limit(q.limit) if q.limit is not None else df
            if by:
                number = fresh("row")
                keep = [c for c in df.columns if c in (*hidden, "__base", "$score", "$distance", "__id")]
                df = df.withColumn(number, F.struct(*[quoted(c) if not d else _flipped(quoted(c), df.schema[c].dataType) for c, d in self._numbering(keep, hidden, ordered)]))
        df = df.select(*[quoted(k) for k in keys], *[quoted(c) for c in columns], *([quoted(number)] if number else []))
        scalar = bool(q.value)
        if scalar and q.items[0].kind == "item" and q.items[0].value.kind == "traverse":
            c = columns[0]
            df = df.select(*[quoted(k) for k in keys], F.explode(quoted(c)).alias(c))
            number = None
        out = Rows(df, columns, refs, scalar, keys, number, lone)
        for path, alias in q.fetch:
            self._fetch(out, path, alias)
        if q.fetch and number and not keys:
            out.df = out.df.orderBy(quoted(number))  # joins do not keep an order
        return out

    @staticmethod
    def _numbering(keep: list[str], hidden: list[str], ordered: list) -> list[tuple[str, bool]]:
        """The columns that tell the order of rows in an array, and whether each descends."""
        out = [(h, d) for h, (_, d) in zip(hidden, ordered) if h in keep]
        if not out:
            out = [("$distance", False)] if "$distance" in keep else [("$score", True)] if "$score" in keep else [("__base", False)] if "__base" in keep else []
        return out + ([("__id", False)] if "__id" in keep else [])

    def where(self, n: Node, s: Scope) -> None:
        """Filter the rows of ``s``; search predicates first, over the whole collection, then the rest."""
        parts = list(conjuncts(n))
        knn = [p for p in parts if p.kind == "nearest"]
        fts = [p for p in parts if p.kind == "full_text"]
        rest = [p for p in parts if p not in knn and p not in fts]
        if len(knn) > 1:
            raise LanguageError("one nearest-neighbour search a query")
        if knn:
            s.df = self._nearest(knn[0], s)
        named = [p.name for p in fts if p.name]
        if len(named) != len(set(named)) or named and len(named) != len(fts):
            raise LanguageError("several searches need different names")
        for p in fts:
            s.df = self._full_text(p, s)
        plain = []
        for p in rest:
            if p.kind == "in_query" and not parent_uses(p.query):
                (value,) = self.prepare([p.value], s)
                rows = self.select(p.query)
                first = rows.columns[0] if rows.scalar else next((c for c in rows.columns if c != "id"), rows.columns[0])
                s.df = self.semi(s.df, self.compile(value, s), rows.df.select(quoted(first).alias("v")), p.no)
            else:
                plain.append(p)
        if plain:
            whole = plain[0]
            for p in plain[1:]:
                whole = Node("binary", op="AND", left=whole, right=p)
            ready = self.prepare(list(conjuncts(whole)), s)
            for p in ready:
                e = self.compile(p, s)
                if len(ready) > 1 and not isinstance(e.type, (T.BooleanType, T.NullType)):
                    raise LanguageError(f"AND needs booleans, not {V.type_word(e.type)}")
                s.df = s.df.where(e.col if isinstance(e.type, T.BooleanType) else V.truthy(e))

    def _analyzer(self, s: Scope, fields: list[str]) -> search.Analyzer:
        c = self.catalog.collection(s.collection) if s.collection else None
        index = c and (c.index("fulltext", tuple(fields)) or None)
        if index is None:
            raise LanguageError(f"full-text search on {', '.join(fields)} needs a FULLTEXT index")
        return self.analyzer(dict(index.options).get("analyzer", "standard"))

    def analyzer(self, name: str) -> search.Analyzer:
        return self.catalog.analyzers.get(name) or builtin_analyzer(name)

    def _full_text(self, p: Node, s: Scope) -> DataFrame:
        names = [f for f, _ in p.fields]
        analyzer = self._analyzer(s, names)
        column = f"$score_{p.name}" if p.name else "$score"
        tie = p.mode[1] if p.mode[0] == "MAX" else None
        had = "$score" in s.df.columns
        df = search.bm25(s.df, p.fields, p.query, analyzer, "__new", tie)
        if p.name:
            df = df.withColumn(column, F.col("__new"))
        df = df.withColumn("$score", F.col("`$score`") + F.col("__new") if had else F.col("__new"))
        return df.drop("__new")

    def _nearest(self, p: Node, s: Scope) -> DataFrame:
        c = self.catalog.collection(s.collection) if s.collection else None
        name = ".".join(p.field)
        index = c and c.index("hnsw", (name,))
        if index is None:
            raise LanguageError(f"vector search on {name} needs an HNSW index")
        options = dict(index.options)
        v = p.vector
        if v.kind == "subquery":
            value = self.constant(v)
            value = value[0] if value else None
            value = next((x for x in value.values() if isinstance(x, list)), None) if isinstance(value, dict) else value
        else:
            value = self.constant(v)
        if not isinstance(value, list) or not value:
            raise LanguageError("vector search needs a vector")
        if options.get("dimension") not in (None, len(value)):
            raise LanguageError(f"the index has dimension {options['dimension']}, the vector {len(value)}")
        return search.nearest(s.df, name, value, p.k, options.get("metric", "COSINE"))

    def _items(self, q: Node, s: Scope) -> list[tuple[str, Node]]:
        out: list[tuple[str, Node]] = []
        for i in q.items:
            if i.kind == "star":
                if s.scalar:
                    out.append(("value", Node("value", path=[])))
                else:
                    out += [(c, Node("field", path=[c])) for c in s.visible()]
            elif i.kind == "expansion":
                out += [(a, Node("field", path=[*i.prefix, f])) for a, f in i.items]
            else:
                out.append((i.alias or display(i.value, i.text), i.value))
        return list(dict(out).items())

    def _grouped(self, q: Node, s: Scope, items: list, order: list, keys: list[str]) -> tuple:
        groups = [tuple(g) for g in q.group]
        calls: dict[Node, str] = {}
        for n in [n for _, n in items] + [n for n, _ in order]:
            for x in walk(n, lambda y: y.kind not in ("subquery", "in_query")):
                if is_aggregate(x):
                    if x.star and x.name != "count":
                        raise LanguageError(f"{x.name.upper()}(*) has no meaning")
                    if not x.star and len(x.args) != 1:
                        raise LanguageError(f"{x.name.upper()} takes one argument")
                    if x.args and x.args[0].kind == "traverse":
                        raise LanguageError("COUNT counts rows; use array::length(->…) for what a traversal reaches")
                    calls.setdefault(x, fresh("a"))
        names = {g: fresh("g") for g in groups}
        args = self.prepare([*[x.args[0] for x in calls if x.args], *[Node("field", path=list(g)) for g in groups]], s)
        by = {}
        it = iter(args)
        aggregates = []
        zero: dict[str, Any] = {}
        for x, name in calls.items():
            e = self.compile(next(it), s) if x.args else None
            aggregates.append(aggregate(x.name, e, x.distinct).alias(name))
            zero[name] = 0 if x.name == "count" else None
        for g in groups:
            by[g] = self.compile(next(it), s)
        df = s.df
        df = df.groupBy(*[quoted(k) for k in keys], *[by[g].col.alias(names[g]) for g in groups]).agg(*aggregates) if aggregates else df.select(*[quoted(k) for k in keys], *[by[g].col.alias(names[g]) for g in groups]).distinct()

        def over(n: Node) -> Node | None:
            if n in calls:
                return Node("column", name=calls[n])
            if n.kind == "field":
                for g in groups:
                    if tuple(n.path[: len(g)]) == g:
                        rest: Node = Node("column", name=names[g])
                        for p in n.path[len(g) :]:
                            rest = Node("access", value=rest, name=p)
                        return rest
                raise LanguageError(f"{'.'.join(n.path)} is neither grouped nor aggregated")
            return None

        new = Scope(df, {}, False, s.parents)
        aliases = {a for a, _ in items}
        done = [(a, rewrite(n, over)) for a, n in items]
        sorts = [(n if n.kind == "field" and len(n.path) == 1 and n.path[0] in aliases else rewrite(n, over), d) for n, d in order]
        lone = None
        if not groups and keys:
            probe = Scope(self.spark.range(1).select(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zero.items()]))
            try:
                lone = list(probe.df.select(*[self.compile(n, probe).col.alias(a) for a, n in done]).first())
            except LanguageError:
                lone = [None] * len(done)
        return new, done, sorts, lone

    # ---- fetch

    def _fetch(self, rows: Rows, path: list[str], alias: str | None) -> None:
        """Replace references along a path by their documents (or put them beside, under an alias)."""
        s = Scope(rows.df, rows.refs)
        for depth in range(1, len(path) + 1):
            part = path[:depth]
            if tuple(part) not in rows.refs:
                continue
            to = rows.refs[tuple(part)]
            name = fresh("f")
            ref = self.field(part, s)
            s.df = self._joined_array(s.df, ref, to, name) if isinstance(ref.type, T.ArrayType) else self._joined(s.df, ref.col, to, name)
            for c in to:
                for p, target in self.catalog.collection(c).refs.items():
                    rows.refs.setdefault((*part, *p), target)
            if not (alias and depth == len(path)):
                del rows.refs[tuple(part)]  # a document now
            if alias and depth == len(path):
                s.df = s.df.withColumn(alias, F.col(name)).drop(name)
                if alias not in rows.columns:
                    rows.columns = [*rows.columns, alias]
            elif depth == 1:
                s.df = s.df.withColumn(part[0], F.col(name)).drop(name)
            else:
                s.df = s.df.withColumn(part[0], _put(quoted(part[0]), part[1:], F.col(name))).drop(name)
        rows.df = s.df


def _put(c: Column, path: list[str], value: Column) -> Column:
    return c.withField(".".join(f"`{p}`" for p in path), value)


def _flipped(c: Column, t: T.DataType) -> Column:
    """A column that ascends as ``c`` descends, for numbers and times; others as they are wrapped for sorting."""
    if V.is_number(t):
        return -c
    if V.is_stamp(t):
        return -F.unix_micros(c.cast("timestamp"))
    if isinstance(t, T.BooleanType):
        return ~c
    # a string's bytes inverted, with an end mark, sort the other way round
    return F.concat(F.translate(F.hex(c.cast("string").cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))


def _union_structs(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    t = V.common([a.schema[name].dataType, b.schema[name].dataType])
    if t is None:
        raise LanguageError("the collections referred to have fields of different kinds")
    wide = lambda d: d.select("__key", V.widened(E(F.col(name), d.schema[name].dataType), t).alias(name))
    return wide(a).unionByName(wide(b))


def conjuncts(n: Node):
    if n.kind == "binary" and n.op == "AND":
        yield from conjuncts(n.left)
        yield from conjuncts(n.right)
    else:
        yield n


def aggregate(name: str, e: E | None, distinct: bool) -> Column:
    if e is None:
        return F.count(F.lit(1))
    c = e.col
    if name == "count":
        return F.countDistinct(c) if distinct else F.count(c)
    if name in ("min", "max"):
        return {"min": F.min, "max": F.max}[name](c)
    if not V.is_number(e.type):
        return F.max(F.lit(None).cast(V.SUMMED if name == "sum" else V.DOUBLE))
    if name == "sum":
        v = c.cast(V.DOUBLE) if V.is_float(e.type) else c.cast(T.DecimalType(28, 0)) if V.is_int(e.type) else c
        return F.sum_distinct(v) if distinct else F.sum(v)
    v = c.cast(V.DOUBLE) if V.is_float(e.type) else c.cast(V.EXACT)
    return F.sum_distinct(v) / F.countDistinct(v) if distinct else F.avg(v)


_LANGUAGES = "arabic danish dutch english finnish french german greek hungarian italian norwegian portuguese romanian russian spanish swedish tamil turkish".split()
BUILTIN_ANALYZERS = frozenset(["standard", "keyword", *_LANGUAGES])


def builtin_analyzer(name: str) -> search.Analyzer:
    if name == "standard":
        return search.STANDARD
    if name == "keyword":
        return search.Analyzer(("keyword",), (("lowercase",),))
    if name in _LANGUAGES:
        return supported(search.Analyzer(("standard",), (("lowercase",), ("stemmer", name))))
    raise LanguageError(f"unknown analyzer {name}")


def supported(a: search.Analyzer) -> search.Analyzer:
    """``a``, unless it asks for a stemmer that isn't there: unstemmed results would be wrong without a word."""
    for f in a.filters:
        if f[0] == "stemmer" and f[1] not in search.STEMMED:
            raise LanguageError(f"there is no stemmer for {f[1]}; there is one for {', '.join(search.STEMMED)}")
    return a


def python(v: Any) -> Any:
    """A collected value as plain Python: rows as dicts."""
    from pyspark.sql import Row

    if isinstance(v, Row):
        return {k: python(x) for k, x in v.asDict().items()}
    if isinstance(v, list):
        return [python(x) for x in v]
    if isinstance(v, bytearray):
        return bytes(v)
    return v
