"""Vote aggregates over edges named ``voted``: one pass and one shuffle by target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signs_of(props: Column, field: str = "value") -> Column:
    """+1 or -1 of a tagged ``value`` (int or float one), else null."""
    got = F.try_element_at(props, F.lit(field))
    text = F.concat(got["tag"].cast("string"), F.lit(":"), got["canon"])
    return F.when(text.isin("2:1", "3:1.0"), F.lit(1)).when(text.isin("2:-1", "3:-1.0"), F.lit(-1))


def vote_aggregates(votes: DataFrame, keys: Sequence[str], weight: str = "weight", sign: str = "sign", created_at: str = "created_at") -> DataFrame:
    """keys, n_votes, laplace, up, down, net, feedback per target.

    ``feedback`` decays by 1/(1 + age) against the newest vote of the whole
    store. The newest time is one row, joined to each vote.
    """
    newest = votes.agg(F.max(created_at).alias("__now"))
    age = F.greatest(F.col("__now") - F.col(created_at), F.lit(0)).cast("double")
    dated = votes.crossJoin(F.broadcast(newest))
    return dated.groupBy(*keys).agg(
        F.count("*").alias("n_votes"), ((F.sum(F.coalesce(F.col(weight).cast("double"), F.lit(1.0))) + 1) / (F.count("*") + 2)).alias("laplace"),
        F.count_if(F.col(sign) == 1).alias("up"), F.count_if(F.col(sign) == -1).alias("down"),
        F.coalesce(F.sum(F.col(sign).cast("long")), F.lit(0)).alias("net"),
        F.coalesce(F.sum(F.col(sign) / (age + 1)), F.lit(0.0)).alias("feedback"),
    )


#: What a record without votes has.
NO_VOTES = {"n_votes": 0, "laplace": 0.5, "up": 0, "down": 0, "net": 0, "feedback": 0.0}


def with_votes(records: DataFrame, aggregates: DataFrame, on: Sequence[str]) -> DataFrame:
    joined = records.join(aggregates, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(aggregates.schema[c].dataType)) for c, v in NO_VOTES.items() if c in aggregates.columns})
