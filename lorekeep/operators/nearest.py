"""The k nearest of a stream of records to many queries, by matrix products; runs in Python workers.

A product of unit vectors only rules pairs out: what may be among the k nearest
is scored again, component by component in order, so that equal vectors score
the same wherever they lie and scores are those of ``cosine``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Records and queries that are multiplied at once.
TILE = 1024
#: More than a product can differ from a score, at any length of a vector.
MARGIN = 1e-9
#: Norms beyond these lose digits when squared or divided; such vectors are scored in order only.
TINY, HUGE = 1e-100, 1e100
NONE = np.iinfo(np.int64).max


def by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of a vector; a missing vector has length 0."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values, start = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
    groups = [(n, np.nonzero(size == n)[0]) for n in np.unique(size)]
    return [(rows, values[start[rows][:, None] + np.arange(n)]) for n, rows in groups]


def norms(m: np.ndarray) -> np.ndarray:
    out = np.zeros(len(m))
    for x in m.T:
        out += x * x
    return np.sqrt(out)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of a * b over the first axis, in order."""
    out = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]))
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


def scores(dot: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    scale = a * b
    zero = (a == 0) | (b == 0) | (scale == 0)
    return np.where(zero, 0.0, dot / np.where(zero, 1.0, scale))


def units(m: np.ndarray, norm: np.ndarray) -> np.ndarray | None:
    """Vectors of length 1 or 0; None if a norm is beyond what a product holds."""
    if not ((norm == 0) | ((norm > TINY) & (norm < HUGE))).all():
        return None
    return m / np.where(norm == 0, 1.0, norm)[:, None]


class Best:
    """For every query its k best, by score and then place; a score that is no number goes last."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.place = k, np.full((n, k), -np.inf), np.full((n, k), NONE)

    def meet(self, near: np.ndarray, queries: np.ndarray, places: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """``near``: about the scores of records (at ``places``) and queries; ``exact``: the scores of pairs."""
        near = np.where(np.isnan(near), -np.inf, near)
        least = self.score[queries, -1]
        if len(near) > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(near, len(near) - self.k, axis=0)[len(near) - self.k])
        r, q = np.nonzero(near >= least - MARGIN)
        score = exact(r, q)
        score = np.where(np.isnan(score), -np.inf, score)
        stays = score >= self.score[queries[q], -1]
        self._add(queries[q[stays]], score[stays], places[r[stays]])

    def _add(self, query: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        met = np.unique(query)
        query = np.concatenate([np.repeat(met, self.k), query])
        score, place = np.concatenate([self.score[met].ravel(), score]), np.concatenate([self.place[met].ravel(), place])
        order = np.lexsort((place, -score, query))
        query = query[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        stays = nth < self.k
        self.score[query[stays], nth[stays]], self.place[query[stays], nth[stays]] = score[order][stays], place[order][stays]


def _meet_all(best: Best, records: list[tuple[np.ndarray, np.ndarray]], queries: list[tuple[np.ndarray, np.ndarray]], first: int) -> None:
    """Every record meets every query, over the shorter length of both."""
    for rows, a in records:
        for at, b in queries:
            n = min(a.shape[1], b.shape[1])
            na, nb = norms(a[:, :n]), norms(b[:, :n])
            ua, ub = units(a[:, :n], na), units(b[:, :n], nb)
            for i in range(0, len(rows), TILE):
                for j in range(0, len(at), TILE):
                    x, y = slice(i, i + TILE), slice(j, j + TILE)
                    ax, by, nax, nby = np.ascontiguousarray(a[x, :n].T), np.ascontiguousarray(b[y, :n].T), na[x], nb[y]
                    if ua is None or ub is None:
                        near = scores(products(ax[:, :, None], by[:, None, :]), nax[:, None], nby[None, :])
                    else:
                        near = ua[x] @ ub[y].T
                    best.meet(near, at[y], first + rows[x], lambda r, q, ax=ax, by=by, nax=nax, nby=nby: scores(_of_pairs(ax, by, r, q), nax[r], nby[q]))


def _of_pairs(a: np.ndarray, b: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
    out = np.zeros(len(r))
    for x, y in zip(a, b, strict=True):
        out += x[r] * y[q]
    return out


def nearest(batches: Iterator[pa.RecordBatch], queries: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """(query id, ids, score) of the k nearest of ``batches`` (ids, vector last; in order of ids) to each of ``queries`` (id, vector)."""
    of = queries.combine_chunks()
    vectors = by_length(pa.concat_arrays(of.column(1).chunks)) if len(of) else []
    best, first, held, kept = Best(len(of), k), 0, np.empty(0, np.int64), None
    with np.errstate(all="ignore"):
        for batch in batches:
            _meet_all(best, by_length(batch.column(batch.num_columns - 1)), vectors, first)
            # ids of the records that are among the best of any query
            wanted = np.unique(best.place[best.place < NONE])
            new, names = wanted[wanted >= first], batch.schema.names[:-1]
            some = pa.Table.from_batches([batch.select(names).take(pa.array(new - first))])
            kept = some if kept is None else pa.concat_tables([kept.filter(pa.array(np.isin(held, wanted))), some])
            held, first = wanted, first + batch.num_rows
    if kept is None:
        return
    query, nth = np.nonzero(best.place < NONE)
    score, row = best.score[query, nth], np.searchsorted(held, best.place[query, nth])
    for i in range(0, len(query), 1 << 16):
        part = slice(i, i + (1 << 16))
        out = [of.column(0).take(pa.array(query[part])), *kept.take(pa.array(row[part])).columns, pa.chunked_array([np.where(np.isneginf(score[part]), np.nan, score[part])])]
        yield from pa.Table.from_arrays(out, names=["q", *kept.schema.names, "score"]).combine_chunks().to_batches()
