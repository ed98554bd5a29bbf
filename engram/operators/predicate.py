"""Predicates compiled to boolean columns, in two-valued logic.

A comparison that can't be made (missing trait, trait that is no number, physical
field against text, field that the scope lacks) is false, so its negation is true.

A map of traits can't be pruned by a file's statistics. :func:`with_hot_traits` gives often used traits columns
of their own, and :func:`select_where` adds to the exact predicate what follows from it in
plain comparisons of columns, which Spark hands to the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics
from ..mql.ast import And, Compare, Not, Or, Predicate
from ..mql.parser import parse_predicate

_NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$"


class Scope:
    """The fields that a predicate may use: physical ones as columns, and a map of traits or none."""

    def __init__(self, physical: Mapping[str, Column], traits: Column | None = None, plain: Mapping[str, tuple[str, float, float]] | None = None):
        self.physical, self.traits = physical, traits
        self.plain = plain or {}  # physical fields that are sign * column + offset, but for a bound at 0


def perception_scope(now: float) -> Scope:
    age = physics.delta_t(now, F.col("tick"))
    weight = physics.weight(now, F.col("salience"), F.col("lambda"), F.col("tick"))
    return Scope({"weight": weight, "salience": F.col("salience"), "age": age}, F.col("traits"), {"salience": ("salience", 1.0, 0.0), "age": ("tick", -1.0, now)})


def fact_scope(now: float, resonance: Column) -> Scope:
    """Facts have a resonance with the query, and no traits."""
    age = physics.delta_t(now, F.col("last_touch"))
    weight = physics.weight(now, F.col("salience"), F.col("lambda"), F.col("last_touch"), F.col("reinforcement"))
    return Scope({"weight": weight, "salience": F.col("salience"), "age": age, "resonance": resonance})


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]


def _numeric(op: str, a: Column, value: float) -> Column:
    """NaN equals nothing and has no order; it differs from everything."""
    return F.when(F.isnan(a), F.lit(op == "!=")).otherwise(_compare(op, a, F.lit(float(value))))


def _leaf(c: Compare, scope: Scope) -> Column:
    if c.physical:
        column = scope.physical.get(c.field)
        return F.lit(False) if column is None or isinstance(c.value, str) else F.coalesce(_numeric(c.op, column, c.value), F.lit(False))
    if scope.traits is None:
        return F.lit(False)
    value = F.try_element_at(scope.traits, F.lit(c.field))
    if isinstance(c.value, str):
        return F.coalesce(_compare(c.op, value, F.lit(c.value)), F.lit(False))
    number = F.when(F.lower(value).rlike(_NUMBER), value.try_cast("double"))
    return F.coalesce(_numeric(c.op, number, c.value), F.lit(False))


def compile_predicate(p: Predicate | str, scope: Scope) -> Column:
    match parse_predicate(p) if isinstance(p, str) else p:
        case Compare() as c:
            return _leaf(c, scope)
        case Not(of):
            return ~compile_predicate(of, scope)
        case And(left, right):
            return compile_predicate(left, scope) & compile_predicate(right, scope)
        case Or(left, right):
            return compile_predicate(left, scope) | compile_predicate(right, scope)
    raise TypeError(p)


# pruning -----------------------------------------------------------------------

_INVERSE = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "==": "!=", "!=": "=="}
_MIRROR = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}


def with_hot_traits(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with columns ``trait_<key>`` and, where it is a number, ``number_<key>``. The map stays as it is."""
    out = {}
    for key in keys:
        value = F.try_element_at(F.col("traits"), F.lit(key))
        out |= {f"trait_{key}": value, f"number_{key}": F.when(F.lower(value).rlike(_NUMBER), value.try_cast("double"))}
    return rows.withColumns(out)


def necessary(p: Predicate | str, scope: Scope, columns: Sequence[str], holds: bool = True) -> Column | None:
    """What must be true of a row's columns for the predicate to hold (or not to), in comparisons that a scan can use; none if nothing is known."""
    match parse_predicate(p) if isinstance(p, str) else p:
        case Compare() as c:
            return _plain(c, scope, columns, holds)
        case Not(of):
            return necessary(of, scope, columns, not holds)
        case And(left, right):
            both = True
        case Or(left, right):
            both = False
        case other:
            raise TypeError(other)
    a, b = necessary(left, scope, columns, holds), necessary(right, scope, columns, holds)
    if both == holds:  # each side alone already follows
        return a if b is None else b if a is None else a & b
    return None if a is None or b is None else a | b


def _plain(c: Compare, scope: Scope, columns: Sequence[str], holds: bool) -> Column | None:
    op = c.op if holds else _INVERSE[c.op]
    if c.physical:
        if c.field not in scope.plain or isinstance(c.value, str) or op in ("==", "!=") or c.value != c.value:
            return None
        name, sign, offset = scope.plain[c.field]
        if name not in columns or (offset and c.value <= 0):  # at 0 the field is bounded
            return None
        at = sign * (c.value - offset)
        slack = 1e-6 * max(1.0, abs(at))  # rounding may move the border; the exact predicate decides there
        op = op if sign > 0 else _MIRROR[op]
        if not holds and op in ("<", "<="):
            return None
        known = _compare(op, F.col(name), F.lit(at - slack if op in (">", ">=") else at + slack))
        return known if holds and not offset else known | F.col(name).isNull()  # without a tick the age is 0
    if isinstance(c.value, str):
        name = f"trait_{c.field}"
        if name not in columns:
            return None
        known = _compare(op, F.col(name), F.lit(c.value))
    else:
        name = f"number_{c.field}"
        # NaN passes no comparison but !=, so it passes most negated ones; a scan sees it as the greatest number.
        if name not in columns or c.value != c.value or (not holds and op in ("<", "<=", "==")):
            return None
        known = _compare(op, F.col(name), F.lit(float(c.value)))
    return known if holds else known | F.col(name).isNull()


def select_where(rows: DataFrame, p: Predicate | str, scope: Scope) -> DataFrame:
    """The rows for which the predicate holds, with what a scan can use of it in front."""
    exact, hint = compile_predicate(p, scope), necessary(p, scope, rows.columns)
    return rows.where(exact if hint is None else hint & exact)
