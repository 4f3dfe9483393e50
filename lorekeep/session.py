"""Plans against a log: later statements see earlier writes, and a plan commits whole or not at all."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lang.parser import parse
from .model import ID_ORDER, RecordId, untagged
from .operators import graph
from .operators.filters import body_equals, text_of
from .operators.ranking import Ranking, rank
from .operators.votes import signs_of, vote_aggregates
from .plans.analyzer import analyze
from .plans.nodes import MUTATIONS, Closure, CreateTable, FieldEquals, HasEmbedding, Insert, Match, Memory, Select
from .sources import log as logs
from .sources.log import LogStore
from .sources.typed import RecordSource


class EngineError(ValueError):
    pass


@dataclass(frozen=True)
class Row:
    id: RecordId
    body: dict
    embedding: tuple[float, ...] | None
    score: float


@dataclass(frozen=True)
class QueryResult:
    """``df`` has pos, rid, score and the record's columns; rows are those of a read in order."""

    statement: Select | Match | Closure
    df: DataFrame
    typed: str | None = None

    @property
    def label(self) -> str:
        s = self.statement
        if isinstance(s, Select):
            return f"SELECT {s.table}"
        return f"{type(s).__name__.upper()} {s.start} {' '.join(map(str, s.steps))}"

    def rows(self) -> list[Row]:
        return list(self.iter_rows())

    def iter_rows(self) -> Iterator[Row]:
        for r in self.df.orderBy("pos").toLocalIterator():
            if self.typed:
                skip = {"pos", "score", self.typed}
                yield Row(RecordId(self.statement.table, r[self.typed]), {k: v for k, v in r.asDict().items() if k not in skip}, None, r["score"])
            else:
                vector = None if r["embedding"] is None else tuple(r["embedding"])
                yield Row(RecordId.parse(r["rid"]), untagged(r["body"]), vector, r["score"])


class Session:
    """``strict`` runs the analyzer first; ``single`` computes similarities in 32-bit steps."""

    def __init__(self, spark: SparkSession, path: str | None = None, strict: bool = False, single: bool = False):
        self.spark, self.strict, self.single = spark, strict, single
        self.store = LogStore(spark, path)
        self.sources: dict[str, RecordSource] = {}

    def register(self, source: RecordSource) -> None:
        self.sources[source.name] = source

    def run(self, text: str) -> list[QueryResult]:
        return self.execute(parse(text))

    def dims(self, memory: str = logs.ROOT) -> dict[str, int]:
        return self.store.state().declared(memory)

    def execute(self, plan: list) -> list[QueryResult]:
        """One result per query. Nothing is written if a statement fails."""
        base, state = self.store.read(), self.store.state()
        if self.strict:
            plan = analyze(plan, state.dims.get(logs.ROOT, {}) | dict.fromkeys(self.sources))
        clock, plan_id = dict(state.clocks), state.plan_id + 1
        known: dict[str, dict] = {}
        memory, new, results = logs.ROOT, [], []
        for s in plan:
            if isinstance(s, Memory):
                memory = s.name
                continue
            if isinstance(s, MUTATIONS):
                if isinstance(s, (CreateTable, Insert)):
                    if memory not in known:
                        known[memory] = state.declared(memory)
                    if isinstance(s, CreateTable):
                        if s.dim is not None and s.dim <= 0:
                            raise EngineError("a vector length must be positive")
                        known[memory][s.table] = s.dim
                    elif s.embedding is not None and (dim := known[memory].get(s.id.table)) is not None and len(s.embedding) != dim:
                        raise EngineError(f"{s.id} has a vector of {len(s.embedding)} components, table {s.id.table} declares {dim}")
                clock[memory] = clock.get(memory, 0) + 1
                new.append(logs.row_of(memory, clock[memory], plan_id, s))
                continue
            log = base.unionByName(logs.frame(self.spark, new)) if new else base
            results.append(self._query(log, memory, s))
        self.store.commit(new)
        return results

    def _query(self, log: DataFrame, memory: str, s) -> QueryResult:
        if isinstance(s, Select):
            return self._select(log, memory, s)
        edges = logs.edges(log, memory)
        nodes = logs.records(log, memory)
        steps = [(x.direction, x.name, body_equals(F.col("props"), x.where.field, x.where.value) if x.where else None) for x in s.steps]
        ids = nodes.select(F.col("rid").alias("id"))
        if isinstance(s, Match):
            from pyspark.sql.window import Window

            got = graph.match(edges, ids, str(s.start), steps)
            got = got.withColumn("pos", F.row_number().over(Window.orderBy("seq")).cast("long") - 1).drop("seq")
        else:
            got = graph.closure(edges, ids, str(s.start), steps).withColumn("score", F.col("depth").cast("double")).drop("depth")
        return QueryResult(s, nodes.join(got, nodes.rid == got.id).drop("id"))

    @staticmethod
    def _votes(log: DataFrame, memory: str, as_of: int | None, table: str | None = None) -> DataFrame:
        """rid and id columns of what was voted on, weight, sign, created_at; of all tables, as the newest vote of any counts."""
        cast = logs.edges(log, memory, as_of).where(F.col("name") == "voted")
        mine = F.lit(True) if table is None else F.col("to_tbl") == table
        return cast.select(
            F.col("dst").alias("rid"), mine.alias("mine"), F.col("to_id_num").alias("id_num"), F.col("to_id_str").alias("id_str"), "weight", signs_of(F.col("props")).alias("sign"), "created_at",
        )

    def _select(self, log: DataFrame, memory: str, s: Select) -> QueryResult:
        if s.table in self.sources:
            if s.as_of is not None:
                raise EngineError(f"table {s.table} is not in the log, so it has no AS OF")
            source = self.sources[s.table]
            votes = source.votes(self._votes(log, memory, None, s.table)) if Ranking(s.knn, s.lexical, s.order).needs_votes else None
            return QueryResult(s, source.select(s, votes, position=True, single=self.single), source.id)
        df = logs.records(log, memory, s.as_of, s.table)
        if isinstance(s.where, FieldEquals):
            df = df.where(body_equals(F.col("body"), s.where.field, s.where.value))
        elif isinstance(s.where, HasEmbedding):
            df = df.where(F.col("embedding").isNotNull())
        ranking, votes = Ranking(s.knn, s.lexical, s.order, s.limit), None
        if ranking.needs_votes:
            votes = vote_aggregates(self._votes(log, memory, s.as_of), ["rid"])
            # aggregates by the id's text, then keyed like the records
            votes = df.select(*ID_ORDER, "rid").join(votes, "rid").drop("rid")
            votes = votes.withColumns({"id_num": F.coalesce("id_num", F.lit(0)), "id_str": F.coalesce("id_str", F.lit(""))})
        df = df.withColumns({"id_num": F.coalesce("id_num", F.lit(0)), "id_str": F.coalesce("id_str", F.lit(""))})
        text = text_of(F.col("body"), s.lexical.field) if s.lexical else None
        return QueryResult(s, rank(df, ID_ORDER, ranking, votes, text=text, single=self.single, position=True))
