"""Statements. A plan is a list of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..model import RecordId
from ..operators.ranking import Knn, Lexical


@dataclass(frozen=True)
class CreateTable:
    table: str
    dim: int | None = None


@dataclass(frozen=True)
class Insert:
    id: RecordId
    body: dict = field(default_factory=dict)
    embedding: tuple[float, ...] | None = None
    created_at: int = 0


@dataclass(frozen=True)
class Relate:
    src: RecordId
    name: str
    dst: RecordId
    weight: float | None = None
    props: dict = field(default_factory=dict)
    created_at: int = 0


@dataclass(frozen=True)
class Forget:
    id: RecordId


@dataclass(frozen=True)
class Memory:
    name: str


@dataclass(frozen=True)
class FieldEquals:
    field: str
    value: object


@dataclass(frozen=True)
class HasEmbedding:
    pass


@dataclass(frozen=True)
class Select:
    table: str
    where: FieldEquals | HasEmbedding | None = None
    knn: Knn | None = None
    lexical: Lexical | None = None
    order: str | None = None
    as_of: int | None = None
    limit: int | None = None
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Step:
    direction: str  # 'out' or 'in'
    name: str
    where: FieldEquals | None = None

    def __str__(self) -> str:
        return f"{'->' if self.direction == 'out' else '<-'}:{self.name}"


@dataclass(frozen=True)
class Match:
    start: RecordId
    steps: tuple[Step, ...]


@dataclass(frozen=True)
class Closure:
    start: RecordId
    steps: tuple[Step, ...]


MUTATIONS = (CreateTable, Insert, Relate, Forget)
QUERIES = (Select, Match, Closure)
