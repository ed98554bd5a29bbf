"""Statements and predicates."""

from __future__ import annotations

from dataclasses import dataclass, field

PHYSICAL = ("weight", "salience", "age", "resonance")


@dataclass(frozen=True)
class Compare:
    field: str
    physical: bool
    op: str  # < <= > >= == !=
    value: float | str


@dataclass(frozen=True)
class Not:
    of: Predicate


@dataclass(frozen=True)
class And:
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Or:
    left: Predicate
    right: Predicate


Predicate = Compare | Not | And | Or


@dataclass(frozen=True)
class Perceive:
    subject: str
    traits: dict[str, str]
    salience: float | None = None
    halflife: float | None = None


@dataclass(frozen=True)
class Distill:
    subject: str
    where: Predicate | None = None
    compressing: bool = False
    retaining: tuple[str, ...] = ()


@dataclass(frozen=True)
class Evoke:
    subject: str
    kind: str = "essence"
    span: float | None = None
    resonating: tuple[str, ...] = ()
    resolution: str | None = None
    projecting: str | None = None
    budget: int | None = None


@dataclass(frozen=True)
class Fade:
    target: str
    where: Predicate | None = None
    preserving: bool = False


@dataclass(frozen=True)
class Imprint:
    archetype: str
    resilience: str | None = None


@dataclass(frozen=True)
class Recall:
    subject: str
    resonating: tuple[str, ...] = ()
    where: Predicate | None = None
    k: int = 3


@dataclass(frozen=True)
class Reinforce:
    subject: str
    resonating: tuple[str, ...] = ()
    k: int = 3


Statement = Perceive | Distill | Evoke | Fade | Imprint | Recall | Reinforce


@dataclass(frozen=True)
class Token:
    kind: str  # word, text, number, mark, end
    value: str
    position: int
    number: float = field(default=0.0)
