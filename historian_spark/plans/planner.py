"""Filter plans: the part of a filter that can be asked early, on fewer tables or columns.

A plan is itself a filter, made of the elements of the whole one, so the same compiler says what
its comparisons mean. It is never stricter than the whole: a condition that cannot be asked early
counts as true where it makes a filter stricter, so And goes on without it, Or that holds one is
given up, and so is everything beneath Not that it is part of. The whole filter is still asked
afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import filters
from .filters import attribute, compile_filter, legal_column, ref

#: Fields that are columns of the anchor, not of typed tables.
ANCHOR_FIELDS = ("EventType", "Time", "SourceNode")
EVENT_TYPE = "EventType"


def field_name(path, aliases: dict[str, str] | None = None) -> str:
    """The last element of an attribute's path, by its alias if it has one; an empty path is the event's type."""
    names = path if isinstance(path, list) else [path]
    last = names[-1] if names else EVENT_TYPE
    return (aliases or {}).get(last, last)


def _leaf(e: dict, aliases: dict[str, str] | None) -> dict | None:
    """A condition on one field with literals alone, the field by its name; else None."""
    known = ("Equals", "GreaterThan", "LessThan", "GreaterThanOrEqual", "LessThanOrEqual", "InList", "Between", "Like", "ILike", "IsNull")
    ops = e["operands"]
    if e["op"] not in known or not ops or "attribute" not in ops[0] or any("literal" not in o for o in ops[1:]):
        return None
    if e["op"] == "Like" and not (len(ops) > 1 and isinstance(ops[1]["literal"], str)):
        return None  # it makes the whole filter false, which nothing early can say
    return filters.element(e["op"], attribute(field_name(ops[0]["attribute"], aliases)), *ops[1:])


@dataclass(frozen=True)
class Plan:
    """A weaker filter; no elements: no condition."""

    elements: list[dict] = field(default_factory=list)

    def _kept(self, keep: Callable[[dict], bool]) -> Plan:
        return _weaker(self.elements, None, keep)

    def without_types(self) -> Plan:
        """The plan without conditions on the event's type."""
        return self._kept(lambda e: _field(e) != EVENT_TYPE)

    def restricted(self, fields: set[str]) -> Plan:
        """The plan's conditions on the given fields and on the event's type."""
        return self._kept(lambda e: _field(e) in fields or _field(e) == EVENT_TYPE)

    def fields(self) -> list[str]:
        """Fields of typed tables that the plan asks for, sorted."""
        return sorted({_field(e) for e in self.elements if e["op"] not in _INNER and _field(e) not in ANCHOR_FIELDS})

    def types(self) -> tuple[list[int], list[str]] | None:
        """Ids and names of the only types that can fit, from the first list that every event must pass; None if any type can.

        Where ids are given, names beside them do not count.
        """
        for e in self._must_pass(len(self.elements) - 1) if self.elements else []:
            if _field(e) == EVENT_TYPE and e["op"] in ("InList", "Equals"):
                values = [o["literal"] for o in e["operands"][1:]]
                ids = [v for v in values if isinstance(v, int) and not isinstance(v, bool)]
                return ids, [] if ids else [str(v).rpartition(";s=")[2].removeprefix("Events.") for v in values]
        return None

    def possible(self, types: list[str]) -> list[str]:
        """Those of the types, by name, that can fit some list of types that every event must pass."""
        for e in self._must_pass(len(self.elements) - 1) if self.elements else []:
            values = [o["literal"] for o in e["operands"][1:]]
            if _field(e) == EVENT_TYPE and e["op"] in ("InList", "Equals") and all(isinstance(v, str | int) and not isinstance(v, bool) for v in values):
                types = [t for t in types if t in {str(v) for v in values}]
        return types

    def _must_pass(self, k: int) -> list[dict]:
        e = self.elements[k]
        return [x for o in e["operands"] for x in self._must_pass(o["element"])] if e["op"] == "And" else [] if e["op"] in _INNER else [e]

    def column(self, schema: T.StructType, aliases: dict[str, str] | None = None) -> Column:
        """The plan as a condition on rows of a schema, as far as its fields are columns there; aliases: the columns of fields."""
        at = lambda e: (aliases or {}).get(_field(e), _field(e))
        plan = self._kept(lambda e: legal_column(at(e)) and at(e) in schema.names)
        named = [e if e["op"] in _INNER else filters.element(e["op"], attribute(at(e)), *e["operands"][1:]) for e in plan.elements]
        return compile_filter(named, schema) if named else F.lit(True)

    def shown(self, k: int | None = None) -> str:
        """The plan as one line."""
        if not self.elements:
            return "all"
        e = self.elements[len(self.elements) - 1 if k is None else k]
        if e["op"] in _INNER:
            parts = [self.shown(o["element"]) for o in e["operands"]]
            return f"not {parts[0]}" if e["op"] == "Not" else "(" + f" {e['op'].lower()} ".join(parts) + ")"
        return " ".join([_field(e), e["op"], *(repr(o["literal"]) for o in e["operands"][1:])])


_INNER = ("And", "Or", "Not")


def _field(e: dict) -> str:
    return e["operands"][0]["attribute"][0]


def _weaker(elements: list[dict], aliases: dict[str, str] | None, keep: Callable[[dict], bool]) -> Plan:
    out: list[dict] = []

    def put(e: dict) -> int:
        out.append(e)
        return len(out) - 1

    def joined(op: str, parts: list[int]) -> int | None:
        return None if not parts else parts[0] if len(parts) == 1 else put(filters.element(op, *map(ref, parts)))

    def at(k, exact: bool, above: tuple = ()) -> int | None:
        """The place of element k in out, None if it is given up; exact: nothing beneath it may be."""
        if not isinstance(k, int) or not 0 <= k < len(elements) or k in above:
            return None
        e, mark = elements[k], len(out)
        if e["op"] not in _INNER:
            leaf = _leaf(e, aliases)
            return put(leaf) if leaf is not None and keep(leaf) else None
        inner = [at(o.get("element"), exact or e["op"] == "Not", (*above, k)) for o in e["operands"]]
        some = [p for p in inner if p is not None]
        if (e["op"] == "Not" and len(inner) != 1) or not some or (len(some) < len(inner) and (exact or e["op"] != "And")):
            del out[mark:]
            return None
        return put(filters.element("Not", ref(some[0]))) if e["op"] == "Not" else joined(e["op"], some)

    if elements:
        at(len(elements) - 1, False)
    return Plan(out)


def build(elements: list[dict] | None, aliases: dict[str, str] | None = None, allowed: set[str] | None = None) -> Plan:
    """The plan of a filter; allowed: the fields that may be asked for, beside the event's type. IsNull may ask for any."""
    return _weaker(elements or [], aliases, lambda e: e["op"] == "IsNull" or allowed is None or _field(e) == EVENT_TYPE or _field(e) in allowed)
