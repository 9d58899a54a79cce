"""Predicates: Python lambdas over a proxy object become column expressions.

The lambda's source is read as a syntax tree, in which ``in``, ``not in``, ``and``, ``or``, ``not`` and chained
comparisons turn into conditions. Without source (as in some shells) the lambda is called as it is; then only
``&``, ``|``, ``~``, ``isin`` and ``overlaps`` can be used.
"""

from __future__ import annotations

import ast
import builtins
import linecache
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from types import CodeType, FunctionType

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import call
from ..functions.stbox import Volume, overlaps, parse_volume

#: Attribute of the object: the column, and the tables that hold it.
ATTRIBUTES: dict[str, tuple[str, frozenset[str]]] = {
    "object_id": ("item_id", frozenset({"trajectories", "bboxes"})),
    "object_type": ("object_type", frozenset({"trajectories"})),
    "color": ("color", frozenset({"trajectories"})),
    "trajectory": ("traj", frozenset({"trajectories"})),
    "location": ("bbox", frozenset({"bboxes"})),
    "timestamp": ("bbox.tmin", frozenset({"bboxes"})),
}


class Location:
    """The box of an object."""

    def __init__(self, column: Column, obj: Obj | None = None):
        self.column = column
        self._obj = obj

    def overlaps(self, volume: Volume | Column | str) -> Column:
        if isinstance(volume, str):
            volume = parse_volume(volume)
        out = overlaps(self.column, volume)
        if self._obj is not None and isinstance(volume, Volume):
            self._obj.overlap = out, volume
        return out

    def __getattr__(self, name: str) -> Column:
        return self.column.getField(name)


class Obj:
    """Stands for an object while a predicate is read; notes which attributes are used."""

    def __init__(self) -> None:
        self.used: set[str] = set()
        self.aggregates = False
        self.overlap: tuple[Column, Volume] | None = None

    def __getattr__(self, name: str):
        if name not in ATTRIBUTES:
            raise AttributeError(f"an object has no {name}; it has {', '.join(ATTRIBUTES)}")
        self.used.add(name)
        column = F.col(ATTRIBUTES[name][0])
        return Location(column, self) if name == "location" else column


@dataclass(frozen=True)
class Predicate:
    """A condition and the attributes it needs; having if it is about groups; volume if it is just an overlap with that one."""

    condition: Column
    uses: frozenset[str]
    having: bool = False
    volume: Volume | None = None


@dataclass
class _Scope(Mapping):
    """Names of a lambda: its argument, given variables, closure, globals, builtins, then functions by name."""

    layers: list[Mapping]
    obj: Obj
    known: dict = field(default_factory=dict)

    def __getitem__(self, name: str):
        for layer in self.layers:
            if name in layer:
                return layer[name]
        if name in ("count", "COUNT"):
            return self._count
        return lambda *args: call(name, *[a.column if isinstance(a, Location) else a for a in args])

    def _count(self, of=None) -> Column:
        self.obj.aggregates = True
        return F.count(F.lit(1) if of is None or isinstance(of, Obj) else of)

    def __iter__(self):
        return iter(self.known)

    def __len__(self) -> int:
        return len(self.known)


def _inside(left, right) -> Column:
    if isinstance(left, Location):
        return left.overlaps(right)
    if isinstance(right, str):
        if isinstance(left, Column):
            return overlaps(left, parse_volume(right))
        raise TypeError("'in' with a string needs a location")
    if isinstance(right, Volume):
        return overlaps(left, right)
    values = list(right)
    return left.isin(values) if values else F.lit(False)


def _truth(x) -> Column:
    return x if isinstance(x, Column) else F.lit(bool(x))


_HELPERS = {
    "_vs_in": _inside,
    "_vs_not": lambda x: ~_truth(x),
    "_vs_and": lambda *xs: reduce(lambda a, b: a & b, map(_truth, xs)),
    "_vs_or": lambda *xs: reduce(lambda a, b: a | b, map(_truth, xs)),
    "_vs_is": lambda a, b: a.isNull() if b is None else a == b,
}


class _Conditions(ast.NodeTransformer):
    @staticmethod
    def _call(name: str, args: list[ast.expr]) -> ast.Call:
        return ast.Call(ast.Name(name, ast.Load()), args, [])

    def visit_BoolOp(self, node: ast.BoolOp) -> ast.Call:  # noqa: N802
        self.generic_visit(node)
        return self._call("_vs_and" if isinstance(node.op, ast.And) else "_vs_or", node.values)

    def visit_UnaryOp(self, node: ast.UnaryOp) -> ast.expr:  # noqa: N802
        self.generic_visit(node)
        return self._call("_vs_not", [node.operand]) if isinstance(node.op, ast.Not) else node

    def visit_Compare(self, node: ast.Compare) -> ast.expr:  # noqa: N802
        self.generic_visit(node)
        parts: list[ast.expr] = []
        for left, op, right in zip([node.left, *node.comparators[:-1]], node.ops, node.comparators, strict=True):
            if isinstance(op, ast.In | ast.NotIn):
                one = self._call("_vs_in", [left, right])
            elif isinstance(op, ast.Is | ast.IsNot):
                one = self._call("_vs_is", [left, right])
            else:
                one = ast.Compare(left, [op], [right])
            parts.append(self._call("_vs_not", [one]) if isinstance(op, ast.NotIn | ast.IsNot) else one)
        return parts[0] if len(parts) == 1 else self._call("_vs_and", parts)


def _extent(code: CodeType) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """First and last place that the code's instructions stand for."""
    spots = [p for p in code.co_positions() if None not in p and p[3] > p[2] or None not in p and p[1] > p[0]]
    return (min((a, c) for a, _, c, _ in spots), max((b, d) for _, b, _, d in spots)) if spots else None


def lambda_tree(fn: FunctionType) -> ast.Lambda | None:
    """The syntax tree of a lambda, found by its place in its file; None without source."""
    lines = linecache.getlines(fn.__code__.co_filename)
    extent = _extent(fn.__code__)
    if not lines or extent is None:
        return None
    try:
        tree = ast.parse("".join(lines))
    except SyntaxError:
        return None
    for node in ast.walk(tree):
        if isinstance(node, ast.Lambda) and len(node.args.args) == 1:
            body = (node.body.lineno, node.body.col_offset), (node.body.end_lineno, node.body.end_col_offset)
            if body[0] <= extent[0] and extent[1] <= body[1] and not any(_holds(x, extent) for x in ast.walk(node.body) if isinstance(x, ast.Lambda)):
                return node
    return None


def _holds(node: ast.Lambda, extent) -> bool:
    return (node.lineno, node.col_offset) <= extent[0] and extent[1] <= (node.end_lineno, node.end_col_offset)


def read_predicate(fn: Callable[[Obj], Column], variables: Mapping | None = None) -> Predicate:
    """The condition that a lambda over an object states. variables: values of names in it, above those in its scope."""
    obj = Obj()
    tree = lambda_tree(fn) if isinstance(fn, FunctionType) and fn.__name__ == "<lambda>" else None
    if tree is None:
        try:
            out = fn(obj)
        except Exception as e:
            raise TypeError("this predicate has no source to read; write it with &, |, ~, isin() and overlaps()") from e
        if not isinstance(out, Column):
            raise TypeError("this predicate has no source to read and gave no condition; write it with &, |, ~, isin() and overlaps()")
    else:
        cells = dict(zip(fn.__code__.co_freevars, (c.cell_contents for c in fn.__closure__ or ()), strict=True))
        scope = _Scope([{tree.args.args[0].arg: obj}, _HELPERS, variables or {}, cells, fn.__globals__, vars(builtins)], obj)
        body = ast.fix_missing_locations(ast.Expression(_Conditions().visit(tree.body)))
        out = _truth(eval(compile(body, "<predicate>", "eval"), {"__builtins__": {}}, scope))
    alone = obj.overlap is not None and out is obj.overlap[0]
    return Predicate(out, frozenset(obj.used), obj.aggregates, obj.overlap[1] if alone else None)


__all__ = ["ATTRIBUTES", "Location", "Obj", "Predicate", "lambda_tree", "read_predicate"]
