"""Record ids, values and their canonical text."""

from __future__ import annotations

import json
import math
import re
import struct
from dataclasses import dataclass

from pyspark.sql import types as T

MAX_U64 = (1 << 64) - 1
NULL, BOOL, INT, FLOAT, STR, DOC, ARR, VECTOR, REF = range(9)


@dataclass(frozen=True)
class RecordId:
    """``table:id``; the id is an unsigned 64-bit number or a string. Numbers sort before strings."""

    table: str
    id: int | str

    @classmethod
    def parse(cls, text: str) -> RecordId:
        table, colon, rest = text.partition(":")
        if not (table and colon and rest):
            raise ValueError(f"not a record id: {text!r}")
        if re.fullmatch(r"\+?[0-9]+", rest, re.ASCII) and int(rest) <= MAX_U64:
            return cls(table, int(rest))
        return cls(table, rest)

    @property
    def kind(self) -> int:
        return int(isinstance(self.id, str))

    def sort_key(self):
        return (self.table.encode(), self.kind, self.id if self.kind == 0 else 0, self.id.encode() if self.kind else b"")

    def columns(self) -> tuple:
        """tbl, id_kind, id_num, id_str, rid."""
        return (self.table, self.kind, None if self.kind else self.id, self.id if self.kind else None, str(self))

    def __str__(self) -> str:
        return f"{self.table}:{self.id}"


class Vector(tuple):
    """A non-empty array of 32-bit floats."""

    __slots__ = ()

    def __new__(cls, xs):
        return super().__new__(cls, (to_f32(x) for x in xs))

    def __eq__(self, other):
        return isinstance(other, Vector) and tuple.__eq__(self, other)

    __hash__ = tuple.__hash__


def to_f32(x: float) -> float:
    return struct.unpack("<f", struct.pack("<f", x))[0] if abs(x) <= 3.4028235677973366e38 or not math.isfinite(x) else math.copysign(math.inf, x)


def f32_text(x: float) -> str:
    """The shortest decimal that reads back as the same 32-bit float."""
    import numpy as np

    return np.format_float_positional(np.float32(x), unique=True, trim="-")


def tag_of(v) -> int:
    for tag, kind in ((NULL, type(None)), (BOOL, bool), (INT, int), (FLOAT, float), (STR, str), (DOC, dict), (VECTOR, Vector), (ARR, list), (REF, RecordId)):
        if isinstance(v, kind):
            return tag
    raise TypeError(f"not a value: {v!r}")


def canon(v) -> str:
    """Equal values of one tag, and only they, have equal text."""
    tag = tag_of(v)
    if tag == NULL:
        return ""
    if tag == BOOL:
        return "true" if v else "false"
    if tag == FLOAT:
        return repr(0.0 if v == 0 else v)
    if tag == DOC:
        return json.dumps({k: [tag_of(v[k]), canon(v[k])] for k in sorted(v)}, ensure_ascii=False)
    if tag == ARR:
        return json.dumps([[tag_of(x), canon(x)] for x in v], ensure_ascii=False)
    if tag == VECTOR:
        return json.dumps([0.0 if x == 0 else x for x in v])
    return str(v)


def from_canon(tag: int, text: str):
    if tag == NULL:
        return None
    if tag == BOOL:
        return text == "true"
    if tag == INT:
        return int(text)
    if tag == FLOAT:
        return float(text)
    if tag == DOC:
        return {k: from_canon(*p) for k, p in json.loads(text).items()}
    if tag == ARR:
        return [from_canon(*p) for p in json.loads(text)]
    if tag == VECTOR:
        return Vector(json.loads(text))
    return RecordId.parse(text) if tag == REF else text


def tagged(body: dict) -> dict:
    return {k: (tag_of(v), canon(v)) for k, v in body.items()}


def untagged(stored: dict | None) -> dict:
    return {k: from_canon(stored[k][0], stored[k][1]) for k in sorted(stored or {})}


VALUE = T.StructType([T.StructField("tag", T.ByteType()), T.StructField("canon", T.StringType())])
BODY = T.MapType(T.StringType(), VALUE)


def id_fields(prefix: str = "") -> list[T.StructField]:
    return [
        T.StructField(f"{prefix}tbl", T.StringType()), T.StructField(f"{prefix}id_kind", T.ByteType()), T.StructField(f"{prefix}id_num", T.DecimalType(20, 0)),
        T.StructField(f"{prefix}id_str", T.StringType()), T.StructField(f"{prefix}rid", T.StringType()),
    ]


#: Ascending record id order.
ID_ORDER = ("tbl", "id_kind", "id_num", "id_str")


def from_json(v):
    """A JSON value as a value: whole numbers of 64 bits are ints, arrays stay arrays."""
    if isinstance(v, float) and not isinstance(v, bool):
        return v
    if isinstance(v, int) and not isinstance(v, bool) and not -(1 << 63) <= v < 1 << 63:
        return float(v)
    if isinstance(v, list):
        return [from_json(x) for x in v]
    if isinstance(v, dict):
        return {k: from_json(x) for k, x in v.items()}
    return v


def to_json(v):
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if isinstance(v, (Vector, list)):
        return [to_json(x) for x in v]
    if isinstance(v, dict):
        return {k: to_json(v[k]) for k in sorted(v)}
    return str(v) if isinstance(v, RecordId) else v
