"""The engine: batches of statements over a catalog; sessions with transactions."""

from __future__ import annotations

import contextlib
import dataclasses
import hashlib
import hmac
import secrets
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import HAS, Catalog, Collection, Edges, Index, settled
from .functions import values as V
from .functions.values import E, LanguageError
from .lang import parse
from .lang.tree import Node, walk
from .operators import dml, graph, search
from .plans.planner import BUILTIN_ANALYZERS, Planner, Rows, Scope, Table, python, quoted, supported


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


class Engine:
    """A database on a Spark session.

    >>> Engine(spark).query("SELECT VALUE $value * 2 FROM 1..3").collect()
    """

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, user: str = "root"):
        self.spark = spark
        self.catalog = catalog or Catalog(spark)
        self.user = user
        self.variables: dict[str, Any] = {}
        self.timeout: float | None = None
        self.users: dict[str, dict] = {}
        self.keys: dict[str, dict] = {}
        self.policies: dict[str, Node] = {}
        self._before: Catalog | None = None  # the shared catalog while a transaction is open
        self._base: dict[str, int] = {}

    # ---- running

    def query(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """The rows of the batch's last statement."""
        results = self.execute(text, params)
        last = results[-1]
        return last if isinstance(last, DataFrame) else self._as_rows(last)

    def execute(self, text: str, params: dict[str, Any] | None = None) -> list[Any]:
        """The result of each statement: a DataFrame, or a plain value."""
        self.variables = dict(params or {})
        out = []
        for n in parse(text):
            try:
                out.append(self.statement(n))
            except Exception:
                if self._before is not None and n.kind not in ("begin",):
                    self.catalog, self._before = self._before, None  # an error ends the transaction
                raise
        return out

    def collect(self, text: str, params: dict[str, Any] | None = None) -> list[Any]:
        """The last statement's rows as Python values, within the timeout that is set."""
        df = self.query(text, params)
        with self.limited():
            rows = [python(r) for r in df.collect()]
        return [r["value"] if list(r) == ["value"] else r for r in rows]

    @contextlib.contextmanager
    def limited(self) -> Iterator[None]:
        """Cancel the jobs started inside once the query timeout has passed."""
        if self.timeout is None:
            yield
            return
        tag = f"facet-{uuid.uuid4().hex}"
        self.spark.addTag(tag)
        timer = threading.Timer(self.timeout, lambda: self.spark.interruptTag(tag))
        timer.start()
        try:
            yield
        finally:
            timer.cancel()
            self.spark.removeTag(tag)

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Engine]:
        """A session with a snapshot of its own; commits at the end, discards on an error."""
        session = self._session(self.catalog.copy(), self.user)
        base = dict(self.catalog.versions)
        yield session
        _merge(self.catalog, session.catalog, base)

    def _session(self, catalog: Catalog, user: str) -> Engine:
        new = Engine(self.spark, catalog, user)
        new.users, new.keys, new.policies = self.users, self.keys, self.policies
        return new

    def session(self, name: str, password: str) -> Engine:
        """Another session on the same data, as a user: each of its statements must be allowed by the policies."""
        if not self.login(name, password):
            raise LanguageError("unknown user or wrong password")
        return self._session(self.catalog, name)

    # ---- statements

    @property
    def planner(self) -> Planner:
        return Planner(self.catalog if self.user == "root" else _Guarded(self.catalog, lambda c: self._need("select", c)), self.variables)

    def statement(self, n: Node) -> Any:
        if self.user != "root":
            self._authorize(n)
        return getattr(self, "_" + n.kind)(n)

    def _need(self, action: str, resource: str) -> None:
        if not self.allowed(self.user, action, resource):
            raise LanguageError(f"{self.user} may not {action} {resource}")

    def _authorize(self, n: Node) -> None:
        """What a statement does by its text; collections reached through references are checked as the planner opens them."""
        for x in walk(n):
            if x.kind in _WRITES:
                self._need(_WRITES[x.kind], x.get("collection") or x.get("label") or "")
            elif x.kind == "from_collection":
                self._need("select", x.collection)
                if any(y.kind in ("full_text", "nearest") for y in walk(n)):
                    self._need("search", x.collection)
            elif x.kind == "step" and x.label in self.catalog.edges:
                self._need("traverse", x.label)
            elif x.kind.startswith(("define_", "create_", "alter_", "drop_")) or x.kind == "reindex":
                self._need("drop" if x.kind.startswith("drop_") else "create" if x.kind in ("define_collection", "create_index") else "manage", x.get("collection") or x.get("name") or "")

    def _rows(self, rows: Rows) -> DataFrame:
        df = rows.df.select(*[quoted(c) for c in rows.columns])
        return df.toDF("value") if rows.scalar and len(rows.columns) == 1 else df

    def _as_rows(self, value: Any) -> DataFrame:
        if isinstance(value, list):
            e = V.literal(value)
            return self.spark.range(1).select(F.explode(e.col).alias("value")) if value else self.spark.range(0).select(F.lit(None).cast("string").alias("value"))
        return self.spark.range(1).select(V.literal(value).col.alias("value"))

    def _select(self, n: Node) -> DataFrame:
        return self._rows(self.planner.select(n))

    def _expression(self, n: Node) -> Any:
        return self._value(n.value)

    def _value(self, n: Node) -> Any:
        """The value of an expression or of control flow."""
        if n.kind == "if":
            for test, block in n.arms:
                if self._truth(self._value(test)):
                    return self._block(block)
            return self._block(n.other)
        if n.kind == "for":
            if n.over.kind == "from_range":
                items: Any = range(self.planner.constant(n.over.low), self.planner.constant(n.over.high) + 1)
            else:
                items = self._plain(self._value(n.over))
            out = []
            outer = dict(self.variables)
            for x in items or []:
                self.variables = {**outer, n.name: x}
                try:
                    out.append(self._plain(self._block(n.body, scope=False)))
                except _Continue:
                    continue
                except _Break:
                    break
                finally:
                    self.variables = dict(outer)
            return out
        if n.kind == "break":
            raise _Break
        if n.kind == "continue":
            raise _Continue
        if n.kind == "subquery":
            return Table(self.planner.select(n.query))
        if n.kind == "variable" and n.name in self.variables:
            return self.variables[n.name]
        return self.planner.constant(n)

    @staticmethod
    def _truth(v: Any) -> bool:
        if isinstance(v, Table):
            return bool(v.rows.df.limit(1).count())
        return bool(v) or type(v).__name__ in ("datetime", "Ref")

    def _plain(self, v: Any) -> Any:
        """Rows as a list of Python values."""
        if isinstance(v, Table):
            v = self._rows(v.rows)
        if isinstance(v, DataFrame):
            got = [python(r) for r in v.collect()]
            return [r["value"] if list(r) == ["value"] else r for r in got]
        return v

    def _block(self, block: list[Node], scope: bool = True) -> Any:
        outer, last = dict(self.variables), None
        try:
            for n in block:
                if n.kind in ("begin", "commit", "rollback", "explain", "set_timeout") or n.kind.startswith(("define", "drop", "create_", "alter")) or n.kind == "reindex":
                    raise LanguageError(f"{n.kind} has no place in a block")
                last = self.statement(n)
        finally:
            if scope:
                self.variables = outer
        return last

    def _let(self, n: Node) -> None:
        self.variables[n.name] = self._value(n.value)

    def _set_timeout(self, n: Node) -> None:
        self.timeout = n.nanos / 1e9

    def _explain(self, n: Node) -> DataFrame:
        if n.statement.kind == "select":
            df = self._select(n.statement)
        else:
            q = Node("select", distinct=False, value=False, items=[Node("star")], source=Node("from_collection", collection=n.statement.collection, key=n.statement.key, path=[], posts=[]), where=n.statement.where, group=[], order=[], limit=None, offset=None, fetch=[])
            df = self._select(q)
        run = df._jdf.queryExecution()
        if n.analyze:
            began = time.perf_counter()
            with self.limited():
                rows = run.toRdd().count()
            taken = (time.perf_counter() - began) * 1000
            text = "\n".join([f"rows: {rows}, time: {taken:.1f} ms", *_measured(run.executedPlan())])
        else:
            text = self.spark._jvm.PythonSQLUtils.explainString(run, "formatted")
        return self.spark.range(1).select(F.lit(text).alias("plan"))

    def _begin(self, n: Node) -> None:
        if self._before is not None:
            raise LanguageError("a transaction is open already")
        self._before, self._base = self.catalog, dict(self.catalog.versions)
        self.catalog = self.catalog.copy()  # writes stay in this session until COMMIT

    def _commit(self, n: Node) -> None:
        if self._before is None:
            raise LanguageError("no transaction is open")
        _merge(self._before, self.catalog, self._base)  # a conflict ends the transaction, as any error does
        self.catalog, self._before = self._before, None

    def _rollback(self, n: Node) -> None:
        if self._before is None:
            raise LanguageError("no transaction is open")
        self.catalog, self._before = self._before, None

    # ---- definitions

    def _no_transaction(self) -> None:
        if self._before is not None:
            raise LanguageError("definitions have no place in a transaction")

    def _define_collection(self, n: Node) -> None:
        self._no_transaction()
        indexes = tuple(self._index(n.name, None, i) for i in n.indexes)
        refs = {(f["name"],): frozenset(x[1] if x[0] != "array" else x[1][1] for x in f["types"] if x[0] == "ref" and x[1] or x[0] == "array" and len(x) > 1 and x[1][0] == "ref" and x[1][1]) for f in n.fields}
        refs = {k: v for k, v in refs.items() if v}
        if n.name in self.catalog.collections:
            old = self.catalog.collections[n.name]
            self.catalog.change(n.name, mode=n.mode, fields=tuple(n.fields), indexes=indexes or old.indexes, refs={**old.refs, **refs})
            return
        df = self.spark.createDataFrame([], T.StructType([T.StructField("id", V.STRING)]))
        self.catalog.put(n.name, df)
        self.catalog.change(n.name, mode=n.mode, fields=tuple(n.fields), indexes=indexes, refs=refs)

    @staticmethod
    def _index(collection: str, name: str | None, i: dict) -> Index:
        auto = "_".join(sorted(i["fields"])) + "_fts" if i["form"] == "fulltext" else f"idx_{collection}_{i['form']}_{'_'.join(i['fields'])}"
        return Index(name or auto, tuple(i["fields"]), i["form"], tuple(i["options"].items()))

    def _create_index(self, n: Node) -> None:
        self._no_transaction()
        c = self.catalog.need(n.collection)
        new = self._index(n.collection, n.name, n.parts)
        if any(i.name == new.name for i in c.indexes):
            raise LanguageError(f"index {new.name} exists")
        if new.form == "unique":
            dml.unique(c.df, new.fields)
        if (analyzer := dict(new.options).get("analyzer")) is not None:
            if new.form != "fulltext":
                raise LanguageError("ANALYZER is for FULLTEXT indexes")
            self.planner.analyzer(analyzer)  # unknown ones raise
        self.catalog.change(n.collection, indexes=(*c.indexes, new))

    def _drop_index(self, n: Node) -> None:
        c = self.catalog.need(n.collection)
        if all(i.name != n.name for i in c.indexes):
            raise LanguageError(f"index {n.name} does not exist")
        self.catalog.change(n.collection, indexes=tuple(i for i in c.indexes if i.name != n.name))

    def _reindex(self, n: Node) -> None:
        if all(i.name != n.name for i in self.catalog.need(n.collection).indexes):
            raise LanguageError(f"index {n.name} does not exist")  # nothing to rebuild: searches read the table itself

    def _drop_collection(self, n: Node) -> None:
        self._no_transaction()
        c = self.catalog.need(n.name)
        if not n.cascade and c.df.limit(1).count():
            raise LanguageError(f"collection {n.name} is not empty; use CASCADE")
        del self.catalog.collections[n.name]
        self.catalog.versions[n.name] = self.catalog.versions.get(n.name, 0) + 1

    def _define_analyzer(self, n: Node) -> None:
        if n.name in BUILTIN_ANALYZERS:
            raise LanguageError(f"{n.name} is a built-in analyzer")
        self.catalog.analyzers[n.name] = supported(search.Analyzer(n.tokenizer, tuple(n.filters)))

    def _drop_analyzer(self, n: Node) -> None:
        if n.name in BUILTIN_ANALYZERS:
            raise LanguageError(f"{n.name} is a built-in analyzer")
        if n.name not in self.catalog.analyzers:
            raise LanguageError(f"analyzer {n.name} does not exist")
        if any(dict(i.options).get("analyzer") == n.name for c in self.catalog.collections.values() for i in c.indexes):
            raise LanguageError(f"analyzer {n.name} is in use")
        del self.catalog.analyzers[n.name]

    def _describe(self, n: Node) -> DataFrame:
        names = [n.name] if n.name else sorted(self.catalog.collections)
        rows = []
        for name in names:
            c = self.catalog.need(name)
            declared = {f["name"]: f for f in c.fields}
            found = {f.name: V.type_word(f.dataType) for f in c.df.schema.fields if not f.name.startswith("__")}
            types = {k: "|".join(x[0] for x in declared[k]["types"]) if k in declared else found[k] for k in dict.fromkeys([*declared, *found])}
            rows.append((name, c.mode or "SCHEMALESS", [f"{k} {t}" for k, t in types.items() if k != "id"], [f"{i.name} {i.form.upper()}({', '.join(i.fields)})" for i in c.indexes]))
        return self.spark.createDataFrame(rows, "name string, mode string, fields array<string>, indexes array<string>")

    # ---- writing

    def _constant(self, n: Node) -> Any:
        if n.kind == "reference":
            return dml.Ref(n.value)
        if n.kind == "object":
            return {k: self._constant(v) for k, v in n.items}
        if n.kind == "array":
            return [self._constant(v) for v in n.items]
        if n.kind == "duration":
            import datetime as dt

            return dt.timedelta(microseconds=n.nanos // 1000)
        return n.value if n.kind == "literal" else self.planner.constant(n)

    def _refs_in(self, rows: list[dict]) -> dict[tuple[str, ...], frozenset[str]]:
        out: dict[tuple[str, ...], set[str]] = {}

        def look(v: Any, path: tuple[str, ...]) -> None:
            if isinstance(v, dml.Ref):
                out.setdefault(path, set()).add(v.split(":", 1)[0])
            elif isinstance(v, dict):
                for k, x in v.items():
                    look(x, (*path, k))
            elif isinstance(v, list):
                for x in v:
                    look(x, path)

        for r in rows:
            look(r, ())
        return {k: frozenset(v) for k, v in out.items()}

    def insert(self, collection: str, rows: list[dict[str, Any]]) -> DataFrame:
        """Insert documents given as dicts, all or none."""
        c = self.catalog.need(collection)
        made = []
        for r in rows:
            r = {k: v for k, v in r.items()}
            for f in c.fields:
                if f["name"] not in r and f["default"] is not None:
                    r[f["name"]] = self._constant(f["default"])
            made.append({"id": dml.document_id(collection, r.pop("id", None)), **r})
        if len({r["id"] for r in made}) < len(made):
            raise LanguageError("a key is given twice")
        return self._added(collection, dml.frame(self.spark, made, HAS), self._refs_in([{k: v for k, v in r.items() if k != "id"} for r in made]))

    def _added(self, collection: str, new: DataFrame, refs: dict) -> DataFrame:
        c = self.catalog.need(collection)
        dml.validate(new, c.fields, c.mode == "STRICT")
        old = c.df if HAS in c.df.columns else c.df.withColumn(HAS, F.array(*[F.lit(x) for x in c.df.columns if x != "id"]).cast("array<string>"))
        if old.join(new.select("id"), "id", "left_semi").limit(1).count():
            raise LanguageError("a document with this key exists")
        self._store(collection, dml.together(old, new), refs)
        return new.drop(HAS)

    def _store(self, collection: str, df: DataFrame, refs: dict | None = None) -> None:
        c = self.catalog.need(collection)
        df = settled(df)
        for i in c.indexes:
            if i.form == "unique":
                dml.unique(df, i.fields)
            if i.form == "hnsw":
                dml.dimension(df, i.fields[0], dict(i.options).get("dimension"))
        own = {k: c.refs.get(k, frozenset()) | (refs or {}).get(k, frozenset()) for k in {*c.refs, *(refs or {})}}
        self.catalog.change(collection, df=df, refs=own)

    def _insert(self, n: Node) -> DataFrame:
        return self.insert(n.collection, [self._constant(r) for r in n.rows])

    @staticmethod
    def _nested(sets: list[tuple[list[str], Node]]) -> list[tuple[str, Node]]:
        """Assignments of paths as one object a top-level field."""
        tree: dict = {}
        for path, v in sets:
            at = tree
            for p in path[:-1]:
                at = at.setdefault(p, {})
                if isinstance(at, Node):
                    raise LanguageError(f"{'.'.join(path)} is set within a value")
            at[path[-1]] = v
        node = lambda t: t if isinstance(t, Node) else Node("object", items=[(k, node(v)) for k, v in t.items()])
        return [(k, node(v)) for k, v in tree.items()]

    def _create(self, n: Node, has_defaults: bool = True) -> DataFrame:
        c = self.catalog.need(n.collection) if n.collection in self.catalog.collections else None
        if c is None:
            self._define_collection(Node("define_collection", name=n.collection, mode=None, fields=[], indexes=[]))
            c = self.catalog.need(n.collection)
        sets = self._nested(n.sets)
        given = next((self._constant(v) for k, v in sets if k == "id"), None)
        sets = [(k, v) for k, v in sets if k != "id"]
        for f in c.fields:
            if f["default"] is not None and all(k != f["name"] for k, _ in sets):
                sets.append((f["name"], f["default"]))
        new = self._row_of(sets).withColumn("id", F.lit(dml.document_id(n.collection, n.key or given)))
        new = new.withColumn(HAS, F.array(*[F.lit(k) for k, _ in sorted(sets)]).cast("array<string>"))
        new = settled(new)
        refs = self._refs_in([{k: self._constant(v) for k, v in sets if v.kind in ("reference", "array", "object") and self._is_constant(v)}])
        return self._added(n.collection, new, refs)

    def _is_constant(self, n: Node) -> bool:
        return n.kind in ("reference", "literal", "duration") or n.kind == "array" and all(map(self._is_constant, n.items)) or n.kind == "object" and all(self._is_constant(v) for _, v in n.items)

    def _row_of(self, sets: list[tuple[str, Node]]) -> DataFrame:
        s = Scope(self.spark.range(1).select(F.lit(None).cast("string").alias("__none")))
        p = self.planner
        ready = p.prepare([v for _, v in sets], s)
        cols = []
        for (k, _), v in zip(sets, ready):
            e = p.compile(v, s)
            cols.append((e.col.cast("string") if V.is_null(e.type) else e.col).alias(k))
        return s.df.select(*cols)

    def _matching(self, n: Node) -> Scope:
        c = self.catalog.collection(n.collection)
        df = c.df
        s = Scope(df, dict(c.refs), collection=n.collection)
        if n.key is not None:
            hit = F.col("id") == f"{n.collection}:{n.key}"
        elif n.where is not None:
            p = self.planner
            (w,) = p.prepare([n.where], s)
            hit = V.truthy(p.compile(w, s))
        else:
            hit = F.lit(True)
        s.df = s.df.withColumn("__hit", hit)
        return s

    def _update(self, n: Node) -> DataFrame:
        return self._assigned(n.collection, self._matching(n), n.sets)

    def _assigned(self, collection: str, s: Scope, sets: list, replace: bool = False) -> DataFrame:
        c = self.catalog.collection(collection)
        p = self.planner
        ready = p.prepare([v for _, v in sets], s)
        values = [p.compile(v, s) for v in ready]
        own = s.types()
        new: dict[str, Any] = {}
        for (path, _), e in zip(sets, values):
            if path[0] == "id":
                raise LanguageError("an id does not change")
            base = new.get(path[0]) or (E(quoted(path[0]), own[path[0]]) if path[0] in own and not path[0].startswith("__") else None)
            if replace and path[0] not in new:
                base = None
            new[path[0]] = _assign(base, path[1:], e)
        cols = []
        for name in dict.fromkeys([*c.df.columns, *new]):
            if name == HAS:
                continue
            old = E(quoted(name), own[name]) if name in own else None
            e = new.get(name)
            if name == "id" or e is None and not replace:
                cols.append(quoted(name))
                continue
            if e is None:
                e = E(F.lit(None).cast(own[name]), own[name])
            if old is None:
                t = V.STRING if V.is_null(e.type) else e.type
                cols.append(F.when(F.col("__hit"), e.col.cast(t) if V.is_null(e.type) else e.col).alias(name))
                continue
            t = V.common([old.type, e.type])
            if t is None:
                cols.append(F.when(F.col("__hit"), dml.variant(e)).otherwise(dml.variant(old)).alias(name))
            else:
                cols.append(F.when(F.col("__hit"), V.widened(e, t)).otherwise(V.widened(old, t)).alias(name))
        tops = F.array(*[F.lit(k) for k in new]).cast("array<string>")
        if HAS in own:
            cols.append(F.when(F.col("__hit"), F.array_sort(tops if replace else F.array_union(HAS, tops))).otherwise(F.col(HAS)).alias(HAS))
        df = settled(s.df.select(*cols, "__hit"))
        hit = df.where("__hit").drop("__hit")
        dml.validate(hit, c.fields, c.mode == "STRICT")
        self._store(collection, df.drop("__hit"))
        return hit.drop(HAS)

    def _upsert(self, n: Node) -> DataFrame:
        c = self.catalog.collection(n.collection)
        if not c.df.where(F.col("id") == f"{n.collection}:{n.key}").limit(1).count():
            return self._create(Node("create", collection=n.collection, key=n.key, sets=n.sets))
        return self._assigned(n.collection, self._matching(Node("update", collection=n.collection, key=n.key, where=None)), n.sets, n.replace)

    def _delete(self, n: Node) -> DataFrame:
        c = self.catalog.collection(n.collection)
        s = self._matching(n)
        df = settled(s.df.select(*[quoted(x) for x in c.df.columns], "__hit"))
        gone = df.where("__hit").drop("__hit")
        if n.collection not in self.catalog.collections:
            return gone
        strict = [e.df for e in self.catalog.edges.values() if e.on_delete == "restrict"]
        if strict and graph.touching(strict, gone).limit(1).count():
            raise LanguageError("edges forbid the deletion")
        for label, e in list(self.catalog.edges.items()):
            if e.on_delete == "cascade":
                self.catalog.change_edges(label, df=settled(graph.without_nodes(e.df, gone)))
        self._store(n.collection, df.where(~F.col("__hit")).drop("__hit"))
        return gone.drop(HAS)

    # ---- edges

    def define_edges(self, label: str, directed: bool = True, single: bool = True, on_delete: str = "cascade") -> None:
        self.catalog.put_edges(label, self.spark.createDataFrame([], "id string, from string, to string, created_at timestamp"), directed=directed, single=single, on_delete=on_delete)

    def _ids(self, side: Any) -> DataFrame:
        if isinstance(side, Node):
            return self._rows(self.planner.select(side)).select("id")
        found = self.spark.createDataFrame([(x,) for x in side], "id string")
        for x in dict.fromkeys(x.split(":", 1)[0] for x in side):
            keys = [k for k in side if k.split(":", 1)[0] == x and ":" in k]
            if keys and self.catalog.collection(x).df.where(F.col("id").isin(keys)).count() < len(set(keys)):
                raise LanguageError(f"a document of {', '.join(keys)} does not exist")
        whole = [x for x in side if ":" not in x]
        for x in whole:
            found = found.where(F.col("id") != x).unionByName(self.catalog.collection(x).df.select("id"))
        return found

    def _relate(self, n: Node) -> DataFrame:
        if n.label not in self.catalog.edges:
            self.define_edges(n.label)
        kind = self.catalog.edges[n.label]
        sets = [(p, v) for p, v in n.sets if p[0] not in ("id", "from", "to")]
        s = Scope(self.spark.range(1).select(F.lit(None).cast("string").alias("__none")))
        p = self.planner
        fields = []
        for name, v in self._nested(sets):
            (v,) = p.prepare([v], s)
            e = p.compile(v, s)
            fields.append((name, e.col.cast("string") if V.is_null(e.type) else e.col))
        extra = s.df.select(*[c.alias(k) for k, c in fields]) if fields else None
        new = graph.related(self._ids(n.source), self._ids(n.to), n.label)
        if extra is not None:
            new = new.crossJoin(F.broadcast(extra))  # one row
        if not kind.single:
            new = new.withColumn("id", F.concat(F.lit(n.label + ":"), F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))))
        if not kind.directed:
            new = new.withColumns({"from": F.least("from", "to"), "to": F.greatest("from", "to")})
        new = settled(new.withColumn("created_at", F.current_timestamp()))
        old = kind.df.join(new.select("from", "to"), ["from", "to"], "left_anti") if kind.single else kind.df
        self.catalog.change_edges(n.label, df=settled(dml.together(old.select(*kind.df.columns), new)), ends=None)  # the new ones may lead elsewhere
        if n.returns == "none":
            return new.agg(F.count(F.lit(1)).alias("count"))
        if isinstance(n.returns, list):
            self_scope = Scope(new)
            items = self.planner._items(Node("select", items=n.returns), self_scope)
            ready = self.planner.prepare([v for _, v in items], self_scope)
            return self_scope.df.select(*[self.planner.compile(v, self_scope).col.alias(a) for (a, _), v in zip(items, ready)])
        return new

    def _delete_edge(self, n: Node) -> DataFrame:
        kind = self.catalog.edges.get(n.label)
        if kind is None:
            return self.spark.range(1).select(F.lit(0).cast("long").alias("deleted"))
        gone = F.col("from") == n.source
        if n.to is not None:
            gone = gone & (F.col("to") == n.to)
        count = kind.df.where(gone).count()
        self.catalog.change_edges(n.label, df=settled(kind.df.where(~gone)))
        return self.spark.range(1).select(F.lit(count).cast("long").alias("deleted"))

    # ---- users and policies

    @staticmethod
    def _hashed(password: str, salt: bytes | None = None) -> tuple[bytes, bytes]:
        salt = salt or secrets.token_bytes(16)
        return salt, hashlib.pbkdf2_hmac("sha256", password.encode(), salt, 100_000)

    def _create_user(self, n: Node) -> None:
        if n.name in self.users:
            raise LanguageError(f"user {n.name} exists")
        self.users[n.name] = {"password": self._hashed(n.password), "attributes": {}}

    def _need_user(self, name: str) -> dict:
        if name not in self.users:
            raise LanguageError(f"user {name} does not exist")
        return self.users[name]

    def _drop_user(self, n: Node) -> None:
        self._need_user(n.name)
        del self.users[n.name]
        self.keys = {k: v for k, v in self.keys.items() if v["user"] != n.name}

    def _alter_user(self, n: Node) -> None:
        u = self._need_user(n.name)
        if n.get("password"):
            u["password"] = self._hashed(n.password)
        u["attributes"].update(n.get("set") or {})
        for k in n.get("remove") or []:
            u["attributes"].pop(k, None)

    def _create_key(self, n: Node) -> DataFrame:
        self._need_user(n.user)
        if n.name in self.keys:
            raise LanguageError(f"key {n.name} exists")
        secret = secrets.token_urlsafe(24)
        self.keys[n.name] = {"user": n.user, "secret": hashlib.sha256(secret.encode()).digest()}
        return self.spark.range(1).select(F.lit(secret).alias("key"))

    def _drop_key(self, n: Node) -> None:
        if self.keys.pop(n.name, None) is None:
            raise LanguageError(f"key {n.name} does not exist")

    def _create_policy(self, n: Node) -> None:
        self.policies[n.name] = n

    def _drop_policy(self, n: Node) -> None:
        if self.policies.pop(n.name, None) is None:
            raise LanguageError(f"policy {n.name} does not exist")

    def _alter_collection(self, n: Node) -> None:
        own = dict(self.catalog.need(n.name).attributes)
        own.update(n.get("set") or {})
        for k in n.get("remove") or []:
            own.pop(k, None)
        self.catalog.change(n.name, attributes=tuple(own.items()))

    def login(self, name: str, password: str) -> bool:
        u = self.users.get(name)
        return u is not None and hmac.compare_digest(u["password"][1], self._hashed(password, u["password"][0])[1])

    def allowed(self, user: str, action: str, collection: str) -> bool:
        """Root may all; else some policy must allow and none deny."""
        if user == "root":
            return True
        facts = {"user": {**self._need_user(user)["attributes"], "name": user}, "resource": {**dict(self.catalog.collection(collection).attributes), "name": collection}}
        facts["collection"] = facts["resource"]

        def holds(field: tuple, op: str, values: list[str]) -> bool:
            v = action if len(field) == 1 else facts.get(field[0], {}).get(field[1])
            return v not in values if op == "!=" else v in values

        met = [p for p in self.policies.values() if all(holds(*t) for t in p.tests)]
        return any(p.allow for p in met) and all(p.allow for p in met)


def _measured(plan: Any, depth: int = 0) -> Iterator[str]:
    """A line for each operator of a physical plan that has run: its name, the rows it gave, the time it took."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _measured(plan.executedPlan(), depth)
        return
    if kind.endswith("QueryStageExec"):
        yield from _measured(plan.plan(), depth)
        return
    below = depth
    if kind not in ("WholeStageCodegenExec", "InputAdapter"):
        below = depth + 1
        found, each = {}, plan.metrics().iterator()
        while each.hasNext():
            pair = each.next()
            found[pair._1()] = (pair._2().metricType(), pair._2().value())
        rows = found.get("numOutputRows", (None, None))[1]
        millis = sum(v / (1e6 if t == "nsTiming" else 1) for t, v in found.values() if t in ("timing", "nsTiming") and v > 0)
        parts = [plan.nodeName().strip(), *([f"rows {rows}"] if rows is not None else []), *([f"{millis:.1f} ms in all tasks"] if millis else [])]
        yield "  " * depth + ", ".join(parts)
    if kind == "ReusedExchangeExec":
        return
    children = plan.children()
    for i in range(children.size()):
        yield from _measured(children.apply(i), below)


#: Statements that write, and the action that policies know them by.
_WRITES = {"insert": "insert", "create": "insert", "upsert": "update", "update": "update", "delete": "delete", "relate": "insert", "delete_edge": "delete"}


class _Guarded(Catalog):
    """A catalog that asks before it opens a collection."""

    def __init__(self, catalog: Catalog, ask: Callable[[str], None]):
        super().__init__(**{f.name: getattr(catalog, f.name) for f in dataclasses.fields(catalog)})
        self.ask = ask

    def collection(self, name: str) -> Collection:
        self.ask(name)
        return super().collection(name)


def _merge(into: Catalog, changed: Catalog, base: dict[str, int]) -> None:
    """Put what a snapshot changed into the shared catalog, unless that changed there since the snapshot was made."""
    touched = {k for k, v in changed.versions.items() if base.get(k) != v}
    late = [k for k in touched if into.versions.get(k) != base.get(k)]
    if late:
        raise LanguageError(f"conflict: {', '.join(sorted(late))} changed since the transaction began")
    for k in touched:
        mine, theirs, name = (into.edges, changed.edges, k[2:]) if k.startswith("->") else (into.collections, changed.collections, k)
        if name in theirs:
            mine[name] = theirs[name]
        else:
            mine.pop(name, None)
        into.versions[k] = changed.versions[k]
    into.analyzers = dict(changed.analyzers)


def _assign(base: E | None, path: list[str], e: E) -> E:
    """``base`` with ``e`` at a path, objects made on the way."""
    if not path:
        return e
    if base is None or V.is_null(base.type):
        return V.obj([(path[0], _assign(None, path[1:], e))])
    if not isinstance(base.type, T.StructType):
        raise LanguageError(f"{V.type_word(base.type)} has no fields to set")
    parts = [(f.name, E(base.col.getField(f.name), f.dataType)) for f in base.type.fields]
    old = dict(parts).get(path[0])
    return V.obj([*parts, (path[0], _assign(old, path[1:], e))])
