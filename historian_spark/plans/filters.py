"""Event filters as data, compiled to one column expression.

A filter is a list of elements, the last is the root. An element is {"op": name, "operands":
[...]}; an operand is {"element": k}, {"attribute": name or path}, or {"literal": value}.
Comparisons with null are false; numbers and booleans compare as doubles, values of unlike
types as strings; unknown operators are true. Leaves stay bare, so that scans can use them;
only beneath Not are they made two-valued.
"""

from __future__ import annotations

import functools
import operator
import re
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.payload import text_of

_COMPARE = {"Equals": operator.eq, "GreaterThan": operator.gt, "LessThan": operator.lt, "GreaterThanOrEqual": operator.ge, "LessThanOrEqual": operator.le}


def element(op: str, *operands) -> dict:
    return {"op": op, "operands": list(operands)}


def attribute(*path: str) -> dict:
    return {"attribute": list(path)}


def literal(value) -> dict:
    return {"literal": value}


def ref(k: int) -> dict:
    return {"element": k}


def source_filter(source, column: str = "source_id") -> list[dict]:
    return [element("Equals", attribute(column), literal(source))]


def type_filter(types: list, column: str = "event_type") -> list[dict]:
    return [element("InList", attribute(column), *map(literal, types))]


def infer_literal(text: str):
    """The value of a text: bool, then int, then float, else the text (node ids are texts here, in their canonical form)."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def property_filter(column: str, op: str, text) -> list[dict]:
    return [element(op, attribute(column), literal(infer_literal(text) if isinstance(text, str) else text))]


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType | T.BooleanType)


class WholeFilterFalse(ValueError):
    """A mistake in a filter that makes no event pass it."""


class Compiler:
    def __init__(self, elements: list[dict], schema: T.StructType, strict_shared: bool = False, node_column: str = "source_id"):
        self.elements, self.types, self.node_column = elements, {f.name: f.dataType for f in schema.fields}, node_column
        self.strict_shared, self.seen, self.stack = strict_shared, set(), []

    def compile(self) -> Column:
        return self.at(len(self.elements) - 1) if self.elements else F.lit(True)

    def at(self, k: int) -> Column:
        if k in self.stack:
            raise ValueError(f"filter element {k} refers to itself")
        if self.strict_shared and k in self.seen:
            return F.lit(False)
        self.seen.add(k)
        self.stack.append(k)
        try:
            e = self.elements[k]
            return getattr(self, f"_{e['op']}", self._unknown)(e["operands"]) if e["op"] not in _COMPARE else self._compare(_COMPARE[e["op"]], e["operands"])
        finally:
            self.stack.pop()

    def _operand(self, o: dict) -> tuple[Column, T.DataType | None]:
        """The operand's column and type; None for a null or missing one."""
        if "literal" in o:
            v = o["literal"]
            kind = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}.get(type(v))
            return F.lit(v if kind is not None or v is None else str(v)), kind if kind is not None or v is None else T.StringType()
        if "attribute" in o:
            path = o["attribute"] if isinstance(o["attribute"], list) else [o["attribute"]]
            if not path and o.get("of") == "NodeId" and self.node_column in self.types:  # the node that emits the event
                return F.col(self.node_column), self.types[self.node_column]
            for name in ("/".join(path), path[0] if path else ""):
                if name in self.types:
                    return F.col(f"`{name}`"), self.types[name]
        return F.lit(None), None

    def _pair(self, a: dict, b: dict, how) -> Column:
        (x, kx), (y, ky) = self._operand(a), self._operand(b)
        if kx is None or ky is None:
            return F.lit(False)
        if kx == ky or (isinstance(kx, T.IntegralType) and isinstance(ky, T.IntegralType)):
            return how(x, y)
        if _numeric(kx) and _numeric(ky):
            double = lambda c, k: c if isinstance(k, T.DoubleType | T.FloatType) else c.cast("double")
            return how(double(x, kx), double(y, ky))
        return how(text_of(x, kx), text_of(y, ky))

    def _compare(self, how, operands: list[dict]) -> Column:
        return self._pair(operands[0], operands[1], how) if len(operands) >= 2 else F.lit(False)

    def _InList(self, operands: list[dict]) -> Column:
        if len(operands) < 2:
            return F.lit(False)
        (x, kind), rest = self._operand(operands[0]), operands[1:]
        if all("literal" in o and self._operand(o)[1] == kind for o in rest) and kind is not None:
            return x.isin([o["literal"] for o in rest])
        return functools.reduce(operator.or_, [self._pair(operands[0], o, operator.eq) for o in rest])

    def _Between(self, operands: list[dict]) -> Column:
        if len(operands) != 3:
            return F.lit(False)
        (x, kx), (lo, kl), (hi, kh) = map(self._operand, operands)
        alike = kx is not None and all(k is not None and (k == kx or (_numeric(k) and _numeric(kx))) for k in (kl, kh))
        return x.between(lo, hi) if alike else F.lit(False)

    def _Like(self, operands: list[dict]) -> Column:
        """% and _ become .* and . of an anchored pattern; other signs keep their meaning in patterns."""
        (x, kind), pattern = self._operand(operands[0]), operands[1].get("literal")
        if not isinstance(pattern, str):
            raise WholeFilterFalse("a pattern must be text")
        if kind is None:
            return F.lit(False)
        return x.cast("string").rlike("^" + pattern.replace("%", ".*").replace("_", ".") + "$")

    def _ILike(self, operands: list[dict]) -> Column:
        """Case-insensitive; * and ? stand for % and _."""
        (x, kind), pattern = self._operand(operands[0]), operands[1].get("literal")
        return x.cast("string").ilike(str(pattern).replace("*", "%").replace("?", "_")) if kind is not None else F.lit(False)

    def _IsNull(self, operands: list[dict]) -> Column:
        if not operands:
            return F.lit(False)
        x, kind = self._operand(operands[0])
        return F.lit(True) if kind is None else x.isNull()

    def _element(self, o: dict) -> Column | None:
        k = o.get("element")
        return self.at(k) if isinstance(k, int) and 0 <= k < len(self.elements) else None

    def _And(self, operands: list[dict]) -> Column:
        parts = [self._element(o) for o in operands]
        return F.lit(False) if any(p is None for p in parts) else functools.reduce(operator.and_, parts, F.lit(True))

    def _Or(self, operands: list[dict]) -> Column:
        parts = [p for o in operands if (p := self._element(o)) is not None]
        return functools.reduce(operator.or_, parts) if parts else F.lit(False)

    def _Not(self, operands: list[dict]) -> Column:
        inner = self._element(operands[0]) if len(operands) == 1 else None
        return F.lit(False) if inner is None else ~F.coalesce(inner, F.lit(False))

    def _unknown(self, operands: list[dict]) -> Column:
        warnings.warn("a filter operator that is not known counts as true", stacklevel=2)
        return F.lit(True)


def compile_filter(elements: list[dict] | None, schema: T.StructType, strict_shared: bool = False, strict_errors: bool = False) -> Column:
    """The filter as a condition. A mistake such as a pattern that is no text makes it false, or with strict_errors raises."""
    try:
        return Compiler(elements or [], schema, strict_shared).compile()
    except WholeFilterFalse:
        if strict_errors:
            raise
        return F.lit(False)


def event_types_of(elements: list[dict], column: str = "event_type") -> list:
    """Literals of the InList elements on the event type."""
    return [o["literal"] for e in elements if e["op"] == "InList" and e["operands"][0].get("attribute") in (column, [column]) for o in e["operands"][1:] if "literal" in o]


def strip_types(elements: list[dict], column: str = "event_type") -> list[dict]:
    """The filter without its conditions on the event type, as far as And alone stands above them.

    Beneath Or and Not they stay: there a condition taken as true would change what the rest means.
    """

    def on_type(k: int) -> bool:
        e = elements[k]
        return e["op"] in ("InList", "Equals") and bool(e["operands"]) and e["operands"][0].get("attribute") in (column, [column])

    def copied(k: int, out: list[dict], strips: bool, above: tuple = ()) -> int:
        """The place in out of element k; strips: whether nothing but And stands above it."""
        if k in above:
            raise ValueError(f"filter element {k} refers to itself")
        e = element("And") if strips and on_type(k) else elements[k]
        inner = lambda o: isinstance(o.get("element"), int) and 0 <= o["element"] < len(elements)
        operands = [ref(copied(o["element"], out, strips and e["op"] == "And", (*above, k))) if inner(o) else o for o in e["operands"]]
        out.append(element(e["op"], *operands))
        return len(out) - 1

    stripped: list[dict] = []
    if elements:
        copied(len(elements) - 1, stripped, True)
    return stripped


def parse_csv_set(text: str | None) -> set[str]:
    return {p.strip() for p in (text or "").split(",") if p.strip()}


def parse_aliases(text: str | None) -> dict[str, str]:
    """name:other pairs; malformed ones are skipped."""
    return {a.strip(): b.strip() for a, s, b in (p.partition(":") for p in (text or "").split(",")) if s and a.strip() and b.strip()}


def expand_fields(fields: set[str], aliases: dict[str, str] | None = None) -> set[str]:
    aliases = aliases or {}
    return fields | {aliases[f] for f in fields if f in aliases} | {a for a, b in aliases.items() if b in fields}


def fields_supported(fields: set[str], configured: set[str], aliases: dict[str, str] | None = None) -> bool:
    return not configured or fields <= expand_fields(configured, aliases)


def legal_column(name: str) -> bool:
    return bool(re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_]*", name))
