"""Eight plain functions over a session: JSON-like values in, JSON text out; errors are ``ERR ...``."""

from __future__ import annotations

import json
from functools import wraps

from ..lang.parser import parse
from ..model import RecordId, from_json, to_f32, to_json
from ..operators.ranking import ORDERS, Knn, Lexical
from ..plans.nodes import Closure, CreateTable, FieldEquals, Forget, Insert, Match, Relate, Select, Step
from ..session import QueryResult, Session


def _rows(result: QueryResult) -> list[dict]:
    return [{"id": str(r.id), "score": to_json(r.score), "body": to_json(r.body)} for r in result.iter_rows()]


def _answered(f):
    @wraps(f)
    def call(*args, **kwargs) -> str:
        try:
            return json.dumps(f(*args, **kwargs), ensure_ascii=False)
        except (ValueError, TypeError, KeyError) as e:
            return f"ERR {e}"

    return call


def _steps(steps: list[dict]) -> tuple[Step, ...]:
    if not steps:
        raise ValueError("a path needs a step")
    out = []
    for s in steps:
        direction = str(s.get("direction", "out")).lower()
        if direction not in ("out", "in"):
            raise ValueError(f"unknown direction {direction}")
        where = s.get("where")
        out.append(Step(direction, s["name"], None if where is None else FieldEquals(where["field"], from_json(where["value"]))))
    return tuple(out)


class Tools:
    def __init__(self, session: Session):
        self.session = session

    @_answered
    def execute(self, program: str):
        return [{"query": r.label, "rows": _rows(r)} for r in self.session.execute(parse(program))]

    @_answered
    def create_table(self, table: str, dim: int | None = None):
        self.session.execute([CreateTable(table, dim)])
        return {"ok": True}

    @_answered
    def insert_record(self, id: str, body: dict, embedding: list[float] | None = None):
        self.session.execute([Insert(RecordId.parse(id), from_json(body), None if embedding is None else tuple(map(to_f32, embedding)))])
        return {"ok": True}

    @_answered
    def relate(self, src: str, name: str, dst: str, weight: float | None = None, props: dict | None = None):
        self.session.execute([Relate(RecordId.parse(src), name, RecordId.parse(dst), weight, from_json(props or {}))])
        return {"ok": True}

    @_answered
    def forget(self, id: str):
        self.session.execute([Forget(RecordId.parse(id))])
        return {"ok": True}

    @_answered
    def select(self, table: str, field: str | None = None, value=None, vector: list[float] | None = None, k: int = 10, text_field: str | None = None,
               query: str | None = None, order: str | None = None, as_of: int | None = None, limit: int | None = None):
        if order is not None and order.lower() not in ORDERS:
            raise ValueError(f"unknown order {order}")
        knn = None if vector is None else Knn(tuple(map(to_f32, vector)), max(k, 1))
        lexical = None if query is None or text_field is None else Lexical(text_field, query, max(k, 1))
        where = None if field is None else FieldEquals(field, from_json(value))
        s = Select(table, where, knn, lexical, order and order.lower(), as_of, limit)
        return _rows(self.session.execute([s])[0])

    @_answered
    def match_path(self, start: str, steps: list[dict]):
        return _rows(self.session.execute([Match(RecordId.parse(start), _steps(steps))])[0])

    @_answered
    def closure(self, start: str, steps: list[dict]):
        return _rows(self.session.execute([Closure(RecordId.parse(start), _steps(steps))])[0])
