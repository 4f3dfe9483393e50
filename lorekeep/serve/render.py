"""Results as text: scores with 4 digits, vectors cut to 4 numbers, arrays to 3 values."""

from __future__ import annotations

import json

from ..model import RecordId, Vector, f32_text
from ..session import QueryResult, Row


def short(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, dict):
        return fields(v)
    if isinstance(v, Vector):
        return f"[{', '.join(map(f32_text, v[:4]))}{', ...' if len(v) > 4 else ''}]"
    if isinstance(v, list):
        return f"[{', '.join(map(short, v[:3]))}]"
    if isinstance(v, float):
        return repr(v).removesuffix(".0")
    return str(v)


def fields(body: dict) -> str:
    return "{" + ", ".join(f"{k}={short(body[k])}" for k in sorted(body)) + "}" if body else "{}"


def row_line(r: Row) -> str:
    return f"{r.id} score={r.score:.4f} {fields(r.body)}"


def line(result: QueryResult) -> str:
    """One line per result, for the line protocol."""
    rows = [row_line(r) for r in result.iter_rows()]
    head = f"{result.label} ({len(rows)} rows)"
    return f"{head}: {'; '.join(rows)}" if rows else head


def block(result: QueryResult) -> str:
    """A head and one line per row, for the console."""
    rows = result.rows()
    return "\n".join([f"{result.label} ({len(rows)} rows)", *(f"  {r.id}  score={r.score:.4f}  {fields(r.body)}" for r in rows)])


def store_dump(session) -> str:
    """Declared tables, records and edges of the root store, in order."""
    from ..model import ID_ORDER, untagged
    from ..sources import log as logs

    log = session.store.read()
    out = ["tables:", *(f"  {t}  VECTOR<f32,{d}>" for t, d in sorted(session.dims().items())), "records:"]
    for r in logs.records(log).orderBy(*ID_ORDER).toLocalIterator():
        vector = "" if r["embedding"] is None else f" emb={short(Vector(r['embedding']))}"
        out.append(f"  {RecordId.parse(r['rid'])}  {fields(untagged(r['body']))}{vector}")
    out.append("edges:")
    for e in logs.edges(log).orderBy("seq").toLocalIterator():
        out.append(f"  {e['src']} -[:{e['name']}]-> {e['dst']}  w={'none' if e['weight'] is None else f32_text(e['weight'])}")
    return "\n".join(out)
