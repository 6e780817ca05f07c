"""Syntax-tree nodes: a kind and named parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any


class Node:
    """``Node("binary", op="+", left=…, right=…)``; parts are attributes, equality is structural."""

    def __init__(self, kind: str, **parts: Any):
        self.kind = kind
        self.parts = parts

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["parts"][name]
        except KeyError:
            raise AttributeError(name) from None

    def get(self, name: str, default: Any = None) -> Any:
        return self.parts.get(name, default)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Node) and (self.kind, self.parts) == (other.kind, other.parts)

    def __hash__(self) -> int:
        return hash(repr(self))

    def __repr__(self) -> str:
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in self.parts.items())})"


def children(x: Any) -> Iterator[Node]:
    if isinstance(x, Node):
        for v in x.parts.values():
            if isinstance(v, Node):
                yield v
            elif isinstance(v, (list, tuple)):
                yield from _inside(v)
    elif isinstance(x, (list, tuple)):
        yield from _inside(x)


def _inside(v: Any) -> Iterator[Node]:
    for y in v:
        if isinstance(y, Node):
            yield y
        elif isinstance(y, (list, tuple)):
            yield from _inside(y)


def walk(x: Node, into: Callable[[Node], bool] = lambda n: True) -> Iterator[Node]:
    """``x`` and all below it; ``into`` tells whether to go below a node."""
    yield x
    if into(x):
        for c in children(x):
            yield from walk(c, into)


def rewrite(x: Any, f: Callable[[Node], Node | None]) -> Any:
    """A copy in which each node for which ``f`` gives another is replaced (from the top down)."""
    if isinstance(x, Node):
        new = f(x)
        if new is not None:
            return new
        return Node(x.kind, **{k: rewrite(v, f) for k, v in x.parts.items()})
    if isinstance(x, list):
        return [rewrite(v, f) for v in x]
    if isinstance(x, tuple):
        return tuple(rewrite(v, f) for v in x)
    return x
