"""Metadata filters: JSON-like dictionaries compiled to one Column, so that Catalyst pushes them to the scan.

The language is two-valued. A field that is null or missing fails every comparison, $ne and $nin and $eq null among them, and
so does a value that cannot be compared. A filter is first read into a tree of three kinds of nodes, which is where malformed ones
are refused. The tree is then compiled, and negation carried down to the leaves: under an even number of $not a leaf is the
bare predicate, which a scan understands, and under an odd number it is ``field is null or not predicate``. A row without any
metadata at all passes no filter, not even a negated one.

A field is a column of its own or, where there is none of that name, an entry of a VARIANT column: metadata of any keys, whose values may
be of another type in each row. There, a comparison looks at the type of the row's value first: whole numbers and booleans are compared exactly,
other numbers as doubles, texts with texts, lists and dictionaries for equality of their JSON. Values are asked for by path and type, so
Spark reads only these entries from the files and pushes what can be pushed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class InvalidFilter(ValueError):
    """The filter is malformed; raised before any job starts."""


@dataclass(frozen=True)
class Operator:
    """build: (column, value or values) to a predicate; unlike: what a value of another kind makes of it."""

    build: Callable[[Column, object], Column]
    unlike: bool = False
    many: bool = False


OPERATORS = {
    "$eq": Operator(lambda c, v: c == v), "$ne": Operator(lambda c, v: c != v, unlike=True), "$gt": Operator(lambda c, v: c > v), "$gte": Operator(lambda c, v: c >= v),
    "$lt": Operator(lambda c, v: c < v), "$lte": Operator(lambda c, v: c <= v), "$in": Operator(lambda c, v: c.isin(v), many=True), "$nin": Operator(lambda c, v: ~c.isin(v), unlike=True, many=True),
}


@dataclass(frozen=True)
class Field:
    name: str
    tests: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class Group:
    every: bool  # or else any
    parts: tuple


@dataclass(frozen=True)
class Negated:
    part: object


def _require(fine: bool, what: str) -> None:
    if not fine:
        raise InvalidFilter(what)


def _group(every: bool):
    def make(name, filters):
        _require(isinstance(filters, list) and filters, f"{name} takes a list with at least one filter")
        return Group(every, tuple(parse(f) for f in filters))

    return make


_NODES = {"$and": _group(True), "$or": _group(False), "$not": lambda name, inner: Negated(parse(inner))}


def _field(name: str, condition) -> Field:
    _require(not name.startswith("$"), f"unknown operator {name}")
    tests = tuple(condition.items()) if isinstance(condition, dict) else (("$eq", condition),)
    _require(bool(tests), f"no condition for {name}")
    for op, value in tests:
        _require(op in OPERATORS, f"unknown comparison {op}")
        _require(isinstance(value, list) or not OPERATORS[op].many, f"{op} takes a list")
    return Field(name, tests)


def parse(query) -> Group:
    """The tree of a filter."""
    _require(isinstance(query, dict) and query, "a filter is a dictionary with at least one entry")
    return Group(True, tuple(_NODES.get(name, _field)(name, x) for name, x in query.items()))


def _kind(x) -> str:
    """Values of one kind can be compared."""
    numbers, texts = (T.NumericType | T.BooleanType, T.StringType) if isinstance(x, T.DataType) else (bool | int | float, str)
    return "number" if isinstance(x, numbers) else "text" if isinstance(x, texts) else "nothing" if x is None else "other"


def _test(c: Column, kind: T.DataType, op: str, value) -> Column:
    operator = OPERATORS[op]
    c = c.cast("int") if isinstance(kind, T.BooleanType) else c
    alike = [int(v) if isinstance(v, bool) else v for v in (value if operator.many else [value]) if _kind(v) == _kind(kind)]
    if not alike:
        return F.lit(operator.unlike)
    return operator.build(c, alike if operator.many else F.lit(alike[0]))


_LONGS = range(-(1 << 63), 1 << 63)


@dataclass(frozen=True)
class Entry:
    """A key of a VARIANT column. Its predicates are never null: a value of another kind makes them false."""

    column: Column
    name: str

    def get(self, kind: str) -> Column:
        quotes = [q for q in "'\"" if q not in self.name]
        if quotes:
            return F.try_variant_get(self.column, f"$[{quotes[0]}{self.name}{quotes[0]}]", kind)
        return F.try_variant_get(F.try_variant_get(self.column, "$", "map<string,variant>")[self.name], "$", kind)

    @property
    def kind(self) -> Column:
        return F.schema_of_variant(self.get("variant"))

    def present(self) -> Column:
        return F.coalesce(self.kind != "VOID", F.lit(False))

    def _of(self, cases: dict[str, Column]) -> Column:
        """The case of the value's kind, false for other kinds. Kinds: whole, real, STRING, nested."""
        kind = self.kind
        found = {"whole": kind.isin("BIGINT", "BOOLEAN"), "real": kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "STRING": kind == "STRING", "nested": kind.rlike("^(ARRAY|OBJECT)<")}
        return F.coalesce(reduce(or_, [found[k] & x for k, x in cases.items()], F.lit(False)), F.lit(False))

    def _whole(self) -> Column:
        return F.coalesce(self.get("bigint"), self.get("boolean").cast("bigint"))

    def test(self, op: str, value) -> Column:
        if op in ("$ne", "$nin"):
            return ~self.any_of(value if op == "$nin" else [value])
        if op in ("$eq", "$in"):
            return self.any_of(value if op == "$in" else [value])
        build, kind = OPERATORS[op].build, _kind(value)
        if kind == "text":
            return self._of({"STRING": build(self.get("string"), F.lit(value))})
        if kind != "number":
            return F.lit(False)
        exact = F.lit(int(value)) if isinstance(value, int) and value in _LONGS else F.lit(float(value))
        real = build(self.get("double"), F.lit(float(value))) & ~F.isnan(self.get("double"))
        return F.lit(False) if math.isnan(value) else self._of({"whole": build(self._whole(), exact), "real": real})

    def any_of(self, values: list) -> Column:
        """Whether the value is one of these."""
        numbers = [x for x in values if _kind(x) == "number" and not math.isnan(x)]
        whole = [int(x) for x in numbers if math.isfinite(x) and int(x) == x and int(x) in _LONGS]
        cases = {
            "whole": (self._whole().isin(whole), whole),
            "real": (self.get("double").isin([float(x) for x in numbers]), numbers),
            "STRING": (self.get("string").isin([x for x in values if _kind(x) == "text"]), [x for x in values if _kind(x) == "text"]),
        }
        nested = [F.to_json(F.parse_json(F.lit(json.dumps(x)))) for x in values if isinstance(x, list | dict)]
        if nested:
            cases["nested"] = (reduce(or_, [F.to_json(self.get("variant")) == x for x in nested]), nested)
        return self._of({k: p for k, (p, some) in cases.items() if some})


def _compiled(node, fields: dict[str, T.DataType], negated: bool, free: Column | None = None) -> Column:
    if isinstance(node, Negated):
        return _compiled(node.part, fields, not negated, free)
    if isinstance(node, Group):
        return reduce(and_ if node.every != negated else or_, [_compiled(p, fields, negated, free) for p in node.parts])
    if node.name not in fields:
        if free is None:
            return F.lit(negated)
        entry = Entry(free, node.name)
        found = reduce(and_, [entry.test(op, value) for op, value in node.tests], entry.present())
        return ~found if negated else found
    c, kind = F.col(f"`{node.name}`"), fields[node.name]
    p = reduce(and_, [_test(c, kind, op, value) for op, value in node.tests])
    # Spark takes NaN for equal to itself and larger than all numbers; here it compares with nothing.
    nan = isinstance(kind, T.FloatType | T.DoubleType) and any(not OPERATORS[op].unlike for op, _ in node.tests)
    if negated:
        return c.isNull() | F.isnan(c) | ~p if nan else c.isNull() | ~p
    return p & c.isNotNull() & ~F.isnan(c) if nan else p & c.isNotNull()


def _has_negation(node) -> bool:
    return isinstance(node, Negated) or isinstance(node, Group) and any(map(_has_negation, node.parts))


#: Columns of a row that are no metadata.
OWN = frozenset(("id", "embedding", "cluster", "dl", "tokens", "_range", "_slot", "_dl", "_terms", "_tfs"))


def _some(f: T.StructField) -> Column:
    """Whether a column has metadata."""
    c = F.col(f"`{f.name}`")
    return F.coalesce(F.schema_of_variant(c).rlike("^OBJECT<.+>$"), F.lit(False)) if isinstance(f.dataType, T.VariantType) else c.isNotNull()


def compile_filter(query: dict | None, schema: T.StructType) -> Column | None:
    """The Column of a filter; None if there is nothing to filter by. Fields that are no columns are looked up in the first VARIANT
    column, if there is one; a name with dots in it is one key."""
    if query is None or query == {}:
        return None
    tree = parse(query)
    free = next((F.col(f"`{f.name}`") for f in schema if isinstance(f.dataType, T.VariantType)), None)
    out = _compiled(tree, {f.name: f.dataType for f in schema if not isinstance(f.dataType, T.VariantType)}, False, free)
    metadata = [_some(f) for f in schema if f.name not in OWN]
    return out & reduce(or_, metadata) if metadata and _has_negation(tree) else out
