"""A scannerless recursive-descent parser for the query language.

Keywords are case-insensitive and end at a word boundary; ``//`` and nested ``/* */`` are comments.
"""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import json
import re
from decimal import Decimal
from typing import Any

from .tree import Node


class ParseError(ValueError):
    """The text is not a statement of the language."""


_WORD = re.compile(r"(?!\d)\w+")
_KEY = re.compile(r"[\w-]+")
_EDGE_KEY = re.compile(r"\w+")
_NUMBER = re.compile(r"-?\d+(?:(?:\.\d+)?dec|\.\d+|f)?", re.I)
_DURATION = re.compile(r"(?:\d+(?:ns|us|ms|s|m|h|d|w|y))+(?![A-Za-z0-9])")
_PIECE = re.compile(r"(\d+)(ns|us|ms|s|m|h|d|w|y)")
_NANOS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9, "y": 365 * 86400 * 10**9}
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"|' + r"'(?:[^'\\]|\\.)*'", re.S)
_QUOTED = re.compile(r"`((?:[^`\\]|\\[`\\])*)`")
_RESERVED = frozenset(
    "SELECT FROM WHERE GROUP ORDER LIMIT OFFSET FETCH AS AND OR NOT IN IS INSERT INTO CREATE SET UPDATE UPSERT REPLACE DELETE RELATE BEGIN COMMIT ROLLBACK DEFINE DROP DESCRIBE "
    "EXPLAIN IF THEN ELSE END FOR DO BREAK CONTINUE LET ASC DESC DISTINCT NULL TRUE FALSE MATCH RETURN CONTENT".split()
)


def duration_nanos(text: str) -> int:
    return sum(int(n) * _NANOS[u] for n, u in _PIECE.findall(text))


def datetime_of(text: str) -> dt.datetime:
    """UTC, to the millisecond; a date alone is its midnight."""
    try:
        v = dt.datetime.fromisoformat(text.replace("Z", "+00:00").replace("z", "+00:00"))
    except ValueError:
        raise ParseError(f"invalid datetime {text!r}") from None
    v = v.replace(tzinfo=dt.timezone.utc) if v.tzinfo is None else v.astimezone(dt.timezone.utc)
    return v.replace(microsecond=v.microsecond // 1000 * 1000)


class Parser:
    def __init__(self, text: str):
        self.text = text
        self.at = 0
        self.deepest = (0, "")

    # ---- scanning

    def skip(self) -> None:
        t, n = self.text, len(self.text)
        while self.at < n:
            if t[self.at].isspace():
                self.at += 1
            elif t.startswith("//", self.at):
                end = t.find("\n", self.at)
                self.at = n if end < 0 else end + 1
            elif t.startswith("/*", self.at):
                depth, i = 1, self.at + 2
                while depth and i < n:
                    if t.startswith("/*", i):
                        depth, i = depth + 1, i + 2
                    elif t.startswith("*/", i):
                        depth, i = depth - 1, i + 2
                    else:
                        i += 1
                if depth:
                    self.fail("end of comment")
                self.at = i
            else:
                return

    def fail(self, wanted: str) -> None:
        line = self.text.count("\n", 0, self.at) + 1
        column = self.at - self.text.rfind("\n", 0, self.at)
        raise ParseError(f"line {line}, column {column}: expected {wanted}, found {self.text[self.at : self.at + 20]!r}")

    def sees(self, sign: str) -> bool:
        self.skip()
        return self.text.startswith(sign, self.at)

    def take(self, sign: str) -> bool:
        if self.sees(sign):
            self.at += len(sign)
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.take(sign):
            self.fail(repr(sign))

    def word(self) -> str | None:
        self.skip()
        m = _WORD.match(self.text, self.at)
        return m[0] if m else None

    def is_kw(self, *names: str) -> bool:
        """Do the words come next?"""
        back = self.at
        ok = self.kw(*names)
        self.at = back
        return ok

    def kw(self, *names: str) -> bool:
        back = self.at
        for n in names:
            w = self.word()
            if w is None or w.upper() != n:
                self.at = back
                return False
            self.at += len(w)
        return True

    def need_kw(self, *names: str) -> None:
        if not self.kw(*names):
            self.fail(" ".join(names))

    def match(self, pattern: re.Pattern) -> str | None:
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
            return m[0]
        return None

    def ident(self, reserved: bool = True) -> str:
        self.skip()
        m = _QUOTED.match(self.text, self.at)
        if m:
            self.at = m.end()
            return re.sub(r"\\([`\\])", r"\1", m[1])
        w = self.word()
        if w is None or (reserved and w.upper() in _RESERVED):
            self.fail("a name")
        self.at += len(w)
        return w

    def string(self) -> str | None:
        self.skip()
        m = _STRING.match(self.text, self.at)
        if not m:
            return None
        self.at = m.end()
        body = m[0][1:-1]
        if m[0][0] == "'":
            body = re.sub(r'\\.|"', lambda x: {'"': '\\"', "\\'": "'"}.get(x[0], x[0]), body, flags=re.S)
        else:
            body = body.replace("\\'", "'") if "\\'" in body else body
        try:
            return json.loads(f'"{body}"', strict=False)
        except ValueError:
            self.fail("a string without unknown escapes")

    def need_string(self) -> str:
        s = self.string()
        if s is None:
            self.fail("a string")
        return s

    def integer(self) -> int:
        self.skip()
        s = self.match(re.compile(r"\d+"))
        if s is None:
            self.fail("an integer")
        return int(s)

    def path(self) -> list[str]:
        out = [self.ident()]
        while self.sees(".") and not self.sees("..") and not self.sees(".{") and not self.sees(".*"):
            back = self.at
            self.at += 1
            try:
                out.append(self.ident(reserved=False))
            except ParseError:
                self.at = back
                break
        return out

    def listed(self, item, *more) -> list:
        out = [item(*more)]
        while self.take(","):
            out.append(item(*more))
        return out

    def attempt(self, f, *more) -> Any:
        """The result of ``f``, or None with nothing consumed if it does not parse."""
        back = self.at
        try:
            return f(*more)
        except ParseError:
            self.at = back
            return None

    # ---- statements

    def batch(self) -> list[Node]:
        out: list[Node] = []
        while True:
            while self.take(";"):
                pass
            self.skip()
            if self.at >= len(self.text):
                break
            out.append(self.statement())
            self.skip()
            if self.at < len(self.text) and not self.sees(";"):
                self.fail("';' or the end")
        if not out:
            self.fail("a statement")
        return out

    def statement(self) -> Node:
        if self.is_kw("SELECT"):
            return self.select()
        if self.kw("INSERT", "INTO"):
            return Node("insert", collection=self.ident(), rows=self.listed(self.constant_object))
        if self.kw("CREATE", "INDEX"):
            name = None if self.is_kw("ON") else self.ident()
            self.need_kw("ON")
            return Node("create_index", name=name, collection=self.ident(), **self.index_body())
        if self.kw("CREATE", "USER"):
            name = self.need_string()
            self.need_kw("PASSWORD")
            return Node("create_user", name=name, password=self.need_string())
        if self.kw("CREATE", "API", "KEY"):
            name = self.need_string()
            self.need_kw("FOR", "USER")
            return Node("create_key", name=name, user=self.need_string())
        if self.kw("CREATE", "POLICY"):
            return self.policy()
        if self.kw("CREATE"):
            c, k = self.target()
            self.need_kw("SET")
            return Node("create", collection=c, key=k, sets=self.listed(self.assignment))
        if self.kw("UPDATE"):
            return self.update()
        if self.kw("UPSERT"):
            c, k = self.target()
            replace = self.kw("REPLACE")
            self.need_kw("SET")
            if k is None:
                self.fail("a key to upsert")
            return Node("upsert", collection=c, key=k, replace=replace, sets=self.listed(self.assignment))
        if self.kw("DELETE"):
            return self.delete()
        if self.kw("RELATE"):
            return self.relate()
        for name in ("BEGIN", "COMMIT", "ROLLBACK"):
            if self.kw(name):
                return Node(name.lower())
        if self.kw("EXPLAIN"):
            analyze = self.kw("ANALYZE")
            if self.is_kw("SELECT"):
                inner = self.select()
            elif self.kw("UPDATE"):
                inner = self.update()
            elif self.kw("DELETE"):
                inner = self.delete()
            else:
                self.fail("SELECT, UPDATE or DELETE")
            return Node("explain", analyze=analyze, statement=inner)
        if self.kw("DEFINE", "COLLECTION"):
            return self.define_collection()
        if self.kw("DEFINE", "ANALYZER"):
            return self.define_analyzer()
        if self.kw("DROP"):
            if self.kw("COLLECTION"):
                return Node("drop_collection", name=self.ident(), cascade=self.kw("CASCADE"))
            if self.kw("INDEX"):
                name = self.ident()
                self.need_kw("ON")
                return Node("drop_index", name=name, collection=self.ident())
            if self.kw("ANALYZER"):
                return Node("drop_analyzer", name=self.ident())
            if self.kw("USER"):
                return Node("drop_user", name=self.need_string())
            if self.kw("API", "KEY"):
                return Node("drop_key", name=self.need_string())
            if self.kw("POLICY"):
                return Node("drop_policy", name=self.ident())
            self.fail("what to drop")
        if self.kw("ALTER", "USER"):
            name = self.need_string()
            if self.kw("PASSWORD"):
                return Node("alter_user", name=name, password=self.need_string())
            if self.kw("SET"):
                return Node("alter_user", name=name, set=dict(self.listed(self.attribute)))
            self.need_kw("REMOVE")
            return Node("alter_user", name=name, remove=self.listed(self.ident))
        if self.kw("ALTER", "COLLECTION"):
            name = self.ident()
            if self.kw("SET"):
                return Node("alter_collection", name=name, set=dict(self.listed(self.attribute)))
            self.need_kw("REMOVE")
            return Node("alter_collection", name=name, remove=self.listed(self.ident))
        if self.kw("REINDEX"):
            name = self.ident()
            self.need_kw("ON")
            return Node("reindex", name=name, collection=self.ident())
        if self.kw("DESCRIBE", "COLLECTIONS"):
            return Node("describe", name=None)
        if self.kw("DESCRIBE", "COLLECTION"):
            return Node("describe", name=self.ident())
        if self.kw("SET", "QUERY_TIMEOUT"):
            self.need("=")
            self.skip()
            text = self.match(_DURATION)
            if text is None:
                self.fail("a duration")
            return Node("set_timeout", nanos=duration_nanos(text))
        if self.kw("LET"):
            self.take("$")
            name = self.ident()
            self.need("=")
            return Node("let", name=name, value=self.expression())
        return Node("expression", value=self.expression())

    def attribute(self) -> tuple[str, str]:
        name = self.ident()
        self.need("=")
        return name, self.need_string()

    def policy(self) -> Node:
        name = self.ident()
        self.need_kw("WHEN")
        tests = [self.policy_test()]
        while self.kw("AND"):
            tests.append(self.policy_test())
        if self.kw("ALLOW"):
            return Node("create_policy", name=name, tests=tests, allow=True)
        self.need_kw("DENY")
        return Node("create_policy", name=name, tests=tests, allow=False)

    def policy_test(self) -> tuple:
        field = (self.ident(reserved=False),)
        if self.take("."):
            field += (self.ident(reserved=False),)
        op = "!=" if self.take("!=") else "=" if self.take("=") else "IN" if self.kw("IN") else self.fail("=, != or IN")
        if self.take("("):
            values = self.listed(self.need_string)
            self.need(")")
        else:
            values = [self.need_string()]
        return field, op, values

    def target(self, key: re.Pattern = _KEY) -> tuple[str, str | None]:
        c = self.ident()
        if self.take(":"):
            return c, self.key(key)
        return c, None

    def key(self, pattern: re.Pattern = _KEY) -> str:
        if self.text.startswith('"', self.at):
            return self.need_string()
        k = self.match(pattern)
        if k is None:
            self.fail("a key")
        return k

    def assignment(self) -> tuple[list[str], Node]:
        p = self.path()
        self.need("=")
        return p, self.expression()

    def update(self) -> Node:
        c, k = self.target()
        self.need_kw("SET")
        sets = self.listed(self.assignment)
        return Node("update", collection=c, key=k, sets=sets, where=self.expression() if self.kw("WHERE") else None)

    def delete(self) -> Node:
        edge = self.attempt(self.delete_edge)
        if edge is not None:
            return edge
        c, k = self.target()
        return Node("delete", collection=c, key=k, where=self.expression() if self.kw("WHERE") else None)

    def delete_edge(self) -> Node:
        a = self.target(_EDGE_KEY)
        self.need("->")
        label = self.ident()
        b = self.target(_EDGE_KEY) if self.take("->") else None
        return Node("delete_edge", source=":".join(filter(None, a)), label=label, to=b and ":".join(filter(None, b)))

    def relate(self) -> Node:
        a = self.relate_side()
        self.need("->")
        label = self.ident()
        self.need("->")
        b = self.relate_side()
        sets: list = []
        if self.kw("SET"):
            sets = self.listed(self.assignment)
        elif self.kw("CONTENT"):
            sets = [([k], v) for k, v in self.constant_object().items]
        returns: Any = "after"
        if self.kw("RETURN"):
            for name in ("NONE", "BEFORE", "AFTER"):
                if self.kw(name):
                    returns = name.lower()
                    break
            else:
                returns = self.listed(self.projection_item)
        return Node("relate", source=a, label=label, to=b, sets=sets, returns=returns)

    def relate_side(self) -> Any:
        if self.take("("):
            q = self.select()
            self.need(")")
            return q
        if self.take("["):
            out = self.listed(lambda: ":".join(filter(None, self.target(_EDGE_KEY))))
            self.need("]")
            return out
        return [":".join(filter(None, self.target(_EDGE_KEY)))]

    # ---- definitions

    def define_collection(self) -> Node:
        name, mode, fields, indexes = self.ident(), None, [], []
        if self.take("("):
            while True:
                if self.is_kw("SCHEMA", "STRICT") or self.is_kw("SCHEMA", "FLEXIBLE"):
                    self.kw("SCHEMA")
                    mode = self.word().upper()
                    self.at += len(mode)
                elif self.kw("INDEX", "ON"):
                    indexes.append(self.index_body())
                else:
                    fields.append(self.field_def())
                if not self.take(","):
                    break
            self.need(")")
            mode = mode or "FLEXIBLE"
        return Node("define_collection", name=name, mode=mode, fields=fields, indexes=indexes)

    def field_def(self) -> dict:
        out: dict = {"name": self.ident(reserved=False), "types": self.field_types(), "required": False, "default": None}
        while True:
            if self.kw("REQUIRED"):
                out["required"] = True
            elif self.kw("DEFAULT"):
                if self.is_kw("NOW"):
                    self.kw("NOW")
                    self.need("(")
                    self.need(")")
                    out["default"] = Node("call", space="time", name="now", args=[], star=False, distinct=False)
                else:
                    out["default"] = self.constant()
            else:
                return out

    def field_types(self) -> list:
        out = [self.field_type()]
        while self.take("|"):
            out.append(self.field_type())
        return out

    def field_type(self) -> Any:
        if self.take("["):
            inner = self.field_type()
            self.need("]")
            return ("array", inner)
        if self.take("{"):
            mode = "FLEXIBLE"
            if self.kw("SCHEMA"):
                mode = self.ident(reserved=False).upper()
                self.take(",")
            fields = [] if self.sees("}") else self.listed(self.field_def)
            self.need("}")
            return ("object", fields, mode)
        w = self.ident(reserved=False).lower()
        if w in ("ref", "reference"):
            to = None
            if self.take("<"):
                to = self.ident()
                self.need(">")
            return ("ref", to)
        if w == "range":
            self.need("<")
            inner = self.field_type()
            self.need(">")
            return ("range", inner)
        if w not in ("any", "string", "int", "float", "decimal", "bool", "datetime", "duration", "bytes", "array", "object", "null"):
            self.fail("a type")
        return (w,)

    def index_body(self) -> dict:
        if self.take("("):
            fields = self.listed(self.path)
            self.need(")")
        else:
            fields = [self.path()]
        out: dict = {"fields": [".".join(f) for f in fields], "form": "btree", "options": {}}
        if self.kw("UNIQUE"):
            out["form"] = "unique"
        elif self.kw("FULLTEXT"):
            out["form"] = "fulltext"
            if self.kw("ANALYZER"):
                out["options"]["analyzer"] = self.ident()
        elif self.kw("HNSW"):
            out["form"] = "hnsw"
            self.need_kw("DIMENSION")
            out["options"]["dimension"] = self.integer()
            if self.kw("DIST"):
                for m in ("COSINE", "EUCLIDEAN", "DOT"):
                    if self.kw(m):
                        out["options"]["metric"] = m
                        break
                else:
                    self.fail("COSINE, EUCLIDEAN or DOT")
            if self.kw("M"):
                out["options"]["m"] = self.integer()
            if self.kw("EF_CONSTRUCTION"):
                out["options"]["ef_construction"] = self.integer()
        return out

    def define_analyzer(self) -> Node:
        name = self.ident()
        self.need_kw("TOKENIZER")
        form = self.ident(reserved=False).lower()
        args: list = []
        if form == "ngram":
            self.need("(")
            args = [self.integer()]
            self.need(",")
            args.append(self.integer())
            self.need(")")
        elif form == "pattern":
            self.need("(")
            args = [self.need_string()]
            self.need(")")
        elif form not in ("standard", "whitespace"):
            self.fail("a tokenizer")
        filters = []
        if self.kw("FILTERS"):
            self.need("[")
            filters = self.listed(self.filter_spec)
            self.need("]")
        return Node("define_analyzer", name=name, tokenizer=(form, *args), filters=filters)

    def filter_spec(self) -> tuple:
        form = self.ident(reserved=False).lower()
        if form in ("lowercase", "ascii_folding"):
            return (form,)
        if form in ("stemmer", "stopwords"):
            self.need("(")
            lang = self.ident()
            self.need(")")
            return form, lang.lower()
        if form == "length":
            self.need("(")
            a = self.integer()
            self.need(",")
            b = self.integer()
            self.need(")")
            return form, a, b
        self.fail("a filter")

    # ---- select

    def select(self) -> Node:
        self.need_kw("SELECT")
        distinct = self.kw("DISTINCT")
        value = self.is_kw("VALUE") and not self.is_kw("VALUE", "FROM") and not self.is_kw("VALUE", "AS")
        if value:
            back = self.at
            self.kw("VALUE")
            if self.sees(",") or self.sees(".") or self.sees(")") or self.sees(";") or self.at >= len(self.text):
                self.at, value = back, False
        items = [Node("star")] if self.take("*") else self.listed(self.projection_item)
        source = self.source() if self.kw("FROM") else None
        where = self.expression() if self.kw("WHERE") else None
        group = self.listed(self.path) if self.kw("GROUP") else []
        order = self.listed(self.order_item) if self.kw("ORDER") else []
        limit = self.integer() if self.kw("LIMIT") else None
        offset = self.integer() if self.kw("OFFSET") else None
        fetch = self.listed(self.fetch_item) if self.kw("FETCH") else []
        return Node("select", distinct=distinct, value=value, items=items, source=source, where=where, group=group, order=order, limit=limit, offset=offset, fetch=fetch)

    def projection_item(self) -> Node:
        spread = self.attempt(self.expansion)
        if spread is not None:
            return spread
        self.skip()
        start = self.at
        e = self.expression()
        text = self.text[start : self.at].strip()
        alias = self.ident(reserved=False) if self.kw("AS") else None
        return Node("item", value=e, alias=alias, text=text)

    def expansion(self) -> Node:
        prefix = [self.ident()]
        while True:
            self.need(".")
            if self.take("{"):
                break
            prefix.append(self.ident(reserved=False))
        items = self.listed(self.expansion_item)
        self.need("}")
        return Node("expansion", prefix=prefix, items=items)

    def expansion_item(self) -> tuple[str, str]:
        a = self.ident(reserved=False)
        return (a, self.ident(reserved=False)) if self.take(":") else (a, a)

    def order_item(self) -> tuple[Node, bool]:
        e = self.expression()
        if self.kw("DESC"):
            return e, True
        self.kw("ASC")
        return e, False

    def fetch_item(self) -> tuple[list[str], str | None]:
        p = self.path()
        return p, self.ident() if self.kw("AS") else None

    def source(self) -> Node:
        if self.sees("("):
            if self.range_ahead():
                return self.range()
            self.need("(")
            inner = self.select() if self.is_kw("SELECT") else self.expression()
            self.need(")")
            return Node("from_query", query=inner) if inner.kind == "select" else Node("from_value", value=inner)
        if self.range_ahead():
            return self.range()
        if self.sees("[") or self.sees("$"):
            return Node("from_value", value=self.primary())
        call = self.attempt(self.call)
        if call is not None:
            return Node("from_value", value=call)
        if self.is_kw("NULL"):
            self.kw("NULL")
            return Node("from_value", value=Node("literal", value=None))
        c, k = self.target()
        path: list[str] = []
        if k is not None and self.sees(".") and not self.sees(".."):
            self.need(".")
            path = self.path()
        posts = []
        while self.sees("["):
            posts.append(self.bracket())
        return Node("from_collection", collection=c, key=k, path=path, posts=posts)

    def range_ahead(self) -> bool:
        back = self.at
        ok = self.attempt(self.range) is not None
        self.at = back
        return ok

    def range(self) -> Node:
        a = self.range_bound()
        self.need("..")
        return Node("from_range", low=a, high=self.range_bound())

    def range_bound(self) -> Node:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.take("$"):
            return Node("variable", name=self.ident())
        self.skip()
        m = self.match(re.compile(r"\d+(?=\s*\.\.|(?!\.|\w))"))
        if m is None:
            self.fail("a range bound")
        return Node("literal", value=int(m))

    # ---- expressions

    def expression(self) -> Node:
        left = self.disjunction()
        while self.take("??"):
            left = Node("coalesce", left=left, right=self.disjunction())
        return left

    def disjunction(self) -> Node:
        left = self.conjunction()
        while self.kw("OR"):
            left = Node("binary", op="OR", left=left, right=self.conjunction())
        return left

    def conjunction(self) -> Node:
        left = self.negation()
        while self.kw("AND"):
            left = Node("binary", op="AND", left=left, right=self.negation())
        return left

    def negation(self) -> Node:
        if self.is_kw("NOT") and not self.is_kw("NOT", "IN"):
            self.kw("NOT")
            return Node("not", value=self.comparison())
        return self.comparison()

    def comparison(self) -> Node:
        left = self.membership()
        for op in (">=", "<=", "!=", "=", ">", "<"):
            if self.sees(op) and not self.sees("<|") and not self.sees("<-"):
                self.need(op)
                return Node("binary", op=op, left=left, right=self.membership())
        if self.kw("IS"):
            no = self.kw("NOT")
            if self.kw("NULL"):
                return Node("is_null", value=left, no=no)
            self.need_kw("NONE")
            return Node("is_none", value=left, no=no)
        return left

    def membership(self) -> Node:
        left = self.addition()
        no = self.kw("NOT", "IN")
        if no or self.kw("IN"):
            if self.take("["):
                items = [] if self.sees("]") else self.listed(self.expression)
                self.need("]")
                return Node("in_list", value=left, items=items, no=no)
            if self.take("("):
                q = self.select()
                self.need(")")
                return Node("in_query", value=left, query=q, no=no)
            if self.take("$"):
                return Node("in_value", value=left, target=self.dollar(), no=no)
            return Node("in_value", value=left, target=Node("field", path=self.path()), no=no)
        return left

    def addition(self) -> Node:
        left = self.product()
        while True:
            if self.take("+"):
                left = Node("binary", op="+", left=left, right=self.product())
            elif self.sees("-") and not self.sees("->"):
                self.need("-")
                left = Node("binary", op="-", left=left, right=self.product())
            else:
                return left

    def product(self) -> Node:
        left = self.unary()
        while True:
            if self.take("*"):
                left = Node("binary", op="*", left=left, right=self.unary())
            elif self.sees("/") and not self.sees("//") and not self.sees("/*"):
                self.need("/")
                left = Node("binary", op="/", left=left, right=self.unary())
            else:
                return left

    def unary(self) -> Node:
        if self.sees("-") and not self.sees("->"):
            self.skip()
            if not _NUMBER.match(self.text, self.at):
                self.need("-")
                return Node("negative", value=self.primary())
        if self.is_kw("NOT"):
            self.kw("NOT")
            return Node("not", value=self.primary())
        return self.primary()

    def primary(self) -> Node:
        e = self.base()
        while True:
            if self.text.startswith("[", self.at) or (self.sees("[") and e.kind in ("field", "variable", "subquery", "call", "parent", "value", "index", "access", "slice", "array", "group", "traverse")):
                kind, *args = self.bracket()
                e = Node("index", value=e, at=args[0]) if kind == "index" else Node("slice", value=e, start=args[0], end=args[1])
            elif self.sees(".") and not self.sees("..") and not self.sees(".{") and not self.sees(".*"):
                self.need(".")
                e = Node("access", value=e, name=self.ident(reserved=False))
            else:
                return e.inner if e.kind == "group" else e

    def bracket(self) -> tuple:
        self.need("[")
        if self.take(".."):
            end = None if self.sees("]") else self.expression()
            self.need("]")
            return "slice", None, end
        first = self.expression()
        if self.take(".."):
            end = None if self.sees("]") else self.expression()
            self.need("]")
            return "slice", first, end
        self.need("]")
        return "index", first

    def base(self) -> Node:
        if self.kw("IF"):
            arms = []
            test = self.expression()
            self.need_kw("THEN")
            arms.append((test, self.block()))
            other: list = []
            while self.kw("ELSE"):
                if self.kw("IF"):
                    test = self.expression()
                    self.need_kw("THEN")
                    arms.append((test, self.block()))
                else:
                    other = self.block()
                    break
            self.need_kw("END")
            return Node("if", arms=arms, other=other)
        if self.kw("FOR"):
            self.need("$")
            name = self.ident()
            self.need_kw("IN")
            e = self.attempt(self.range) or self.expression()
            self.need_kw("DO")
            body = self.block()
            self.need_kw("END")
            return Node("for", name=name, over=e, body=body)
        if self.kw("BREAK"):
            return Node("break")
        if self.kw("CONTINUE"):
            return Node("continue")
        if self.sees("<->") or self.sees("->") or self.sees("<-"):
            return self.traversal()
        if self.sees("("):
            self.need("(")
            if self.is_kw("SELECT"):
                q = self.select()
                self.need(")")
                return Node("subquery", query=q)
            e = self.expression()
            self.need(")")
            return Node("group", inner=e)
        if self.take("$"):
            return self.dollar()
        if self.is_kw("MATCH"):
            return self.full_text()
        if self.take("{"):
            return Node("object", items=self.pairs(self.expression))
        if self.take("["):
            items = [] if self.sees("]") else self.listed(self.expression)
            self.need("]")
            return Node("array", items=items)
        literal = self.literal()
        if literal is not None:
            return literal
        call = self.attempt(self.call)
        if call is not None:
            return call
        search = self.attempt(self.full_text) or self.attempt(self.nearest)
        if search is not None:
            return search
        back = self.at
        name = self.ident()
        if self.text.startswith("::", self.at):
            self.at += 2
            return Node("constant", space=name.lower(), name=self.ident(reserved=False).lower())
        if self.text.startswith(":", self.at) and not self.text.startswith("::", self.at):
            self.at += 1
            return Node("reference", value=f"{name}:{self.key()}")
        self.at = back
        return Node("field", path=self.path())

    def block(self) -> list[Node]:
        out = []
        while not (self.is_kw("END") or self.is_kw("ELSE")):
            if self.take(";"):
                continue
            out.append(self.statement())
            if not self.sees(";") and not (self.is_kw("END") or self.is_kw("ELSE")):
                self.fail("';' or END")
        return out

    def dollar(self) -> Node:
        name = self.ident(reserved=False)
        if name == "value":
            return Node("value", path=self.tail())
        if name == "parent":
            levels, path = 1, self.tail()
            while path and path[0] == "parent":
                levels, path = levels + 1, path[1:]
            if not path:
                self.fail("a field of $parent")
            return Node("parent", levels=levels, path=path)
        return Node("variable", name=name)

    def tail(self) -> list[str]:
        out: list[str] = []
        while self.text.startswith(".", self.at) and not self.text.startswith("..", self.at):
            self.at += 1
            out.append(self.ident(reserved=False))
        return out

    def pairs(self, item) -> list[tuple[str, Node]]:
        out = []
        while not self.take("}"):
            if out:
                self.need(",")
            name = self.string()
            if name is None:
                name = self.ident(reserved=False)
            self.need(":")
            out.append((name, item()))
        return out

    def call(self) -> Node:
        space, name = None, self.ident()
        if self.text.startswith("::", self.at):
            self.at += 2
            space, name = name, self.ident(reserved=False)
        self.skip()
        if not self.text.startswith("(", self.at):
            self.fail("'('")
        self.at += 1
        star, distinct, args = False, False, []
        if self.take("*"):
            star = True
        elif self.kw("DISTINCT"):
            distinct, args = True, [self.expression()]
        elif not self.sees(")"):
            args = self.listed(self.expression)
        self.need(")")
        return Node("call", space=space and space.lower(), name=name.lower(), args=args, star=star, distinct=distinct)

    def literal(self) -> Node | None:
        self.skip()
        t = self.text[self.at : self.at + 2]
        if t[:1] in ("d", "b") and t[1:] in ('"', "'"):
            self.at += 1
            s = self.need_string()
            if t[0] == "d":
                return Node("literal", value=datetime_of(s))
            try:
                return Node("literal", value=base64.b64decode(s, validate=True))
            except (binascii.Error, ValueError):
                raise ParseError(f"invalid base64 {s!r}") from None
        if t == "0x":
            hexed = self.match(re.compile(r"0x[0-9a-fA-F]+"))
            if hexed is None or len(hexed) % 2:
                self.fail("pairs of hex digits")
            return Node("literal", value=bytes.fromhex(hexed[2:]))
        d = self.match(_DURATION)
        if d is not None:
            return Node("duration", nanos=duration_nanos(d))
        number = self.number()
        if number is not None:
            return number
        s = self.string()
        if s is not None:
            return Node("literal", value=s)
        for name, v in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.kw(name):
                return Node("literal", value=v)
        return None

    def number(self) -> Node | None:
        self.skip()
        m = _NUMBER.match(self.text, self.at)
        if m is None:
            return None
        s = m[0]
        if self.text.startswith("..", m.start() + len(s.split(".")[0])):
            s = s.split(".")[0]
        self.at += len(s)
        low = s.lower()
        if low.endswith("dec"):
            return Node("literal", value=Decimal(low[:-3]))
        if low.endswith("f"):
            return Node("literal", value=float(low[:-1]))
        if "." in s:
            return Node("literal", value=float(s))
        v = int(s)
        if not -(1 << 63) <= v < 1 << 63:
            raise ParseError(f"integer {s} is out of range")
        return Node("literal", value=v)

    def constant(self) -> Node:
        if self.take("["):
            items = [] if self.sees("]") else self.listed(self.constant)
            self.need("]")
            return Node("array", items=items)
        if self.sees("{"):
            return self.constant_object()
        literal = self.literal()
        if literal is not None:
            return literal
        name = self.ident()
        self.need(":")
        return Node("reference", value=f"{name}:{self.key()}")

    def constant_object(self) -> Node:
        self.need("{")
        return Node("object", items=self.pairs(self.constant))

    def full_text(self) -> Node:
        mode: tuple = ("SUM",)
        if self.kw("MATCH"):
            self.need("(")
            fields = self.listed(self.match_field)
            self.need(")")
            if self.kw("MODE"):
                if self.kw("MAX"):
                    mode = ("MAX", 0.0)
                    if self.take("("):
                        mode = ("MAX", float(self.number().value))
                        self.need(")")
                else:
                    self.need_kw("SUM")
            several = True
        else:
            fields, several = [(".".join(self.path()), 1.0)], False
        name = None
        if self.take("@:"):
            name = self.ident()
            self.need("@")
        else:
            self.need("@@")
        return Node("full_text", fields=fields, several=several, mode=mode, name=name, query=self.need_string())

    def match_field(self) -> tuple[str, float]:
        name = self.ident()
        return name, float(self.number().value) if self.take("^") else 1.0

    def nearest(self) -> Node:
        field = self.path()
        self.need("<|")
        k = self.integer()
        effort = self.integer() if self.take(",") else None
        self.need("|>")
        return Node("nearest", field=field, k=k, effort=effort, vector=self.primary())

    # ---- graph

    def direction(self) -> str:
        for d in ("<->", "->", "<-"):
            if self.take(d):
                return d
        self.fail("a direction")

    def traversal(self) -> Node:
        steps = []
        while self.sees("->") or self.sees("<-"):
            d = self.direction()
            where = None
            if self.take("("):
                label = self.ident()
                self.need_kw("WHERE")
                where = self.expression()
                self.need(")")
            elif self.take("*"):
                label = "*"
            else:
                label = self.ident()
            low, high, everything = 1, 1, False
            ranged = False
            if self.take("{"):
                ranged = True
                low, high = self.depth()
                everything = self.kw("ALL")
                self.need("}")
            fields: Any = None
            if self.take(".*"):
                fields = "*"
            elif self.sees(".{"):
                self.need(".{")
                fields = self.listed(self.traversal_item)
                self.need("}")
            elif self.sees(".") and not self.sees(".."):
                self.need(".")
                p = self.path()
                fields = [(p[-1], p)]
            steps.append(Node("step", direction=d, label=label, where=where, low=low, high=high, ranged=ranged, everything=everything, fields=fields))
            if fields is not None:
                break
        return Node("traverse", steps=steps)

    def depth(self) -> tuple[int, int | None]:
        if self.take(".."):
            return 1, None if self.sees("}") or self.is_kw("ALL") else self.integer()
        low = self.integer()
        if self.take(".."):
            return low, None if self.sees("}") or self.is_kw("ALL") else self.integer()
        return low, low

    def traversal_item(self) -> tuple[str, list[str]]:
        p = self.path()
        if len(p) == 1 and self.take(":"):
            return p[0], self.path()
        return p[-1], p


def parse(text: str) -> list[Node]:
    """The statements of a batch."""
    return Parser(text).batch()


def parse_expression(text: str) -> Node:
    p = Parser(text)
    e = p.expression()
    p.skip()
    if p.at < len(text):
        p.fail("the end")
    return e
