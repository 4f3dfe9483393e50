r"""Chat formatting: conversations to token-budgeted training windows.

Method: prefix sums of turn tokens choose turn-aligned spans; every window
retains the system turn, repeats a limited history, and masks the targets it
repeats, so each assistant text is under the loss mask in exactly one window.

Conversations of up to ``HOT_BYTES`` are shuffled once, by conversation: sums,
spans, windows and digests follow from that one order. Larger ones (one may hold
a third of all turns) take a two-level scan. Their turns are range-partitioned by
(conversation, turn); each partition sums its own part, the few part-sums of a
conversation are scanned, and the result is added back, so no step needs a whole
conversation in one task. Sums and spans are found on rows without texts; a text
is staged once, meets its windows once, and is shuffled once more to the other
turns of its window. Both ways give the same windows.

A turn's tokens are by default bounded from above by its bytes as formatted,
markup and white space included: no tokenizer of bytes or larger pieces makes
more. ``counted`` adds the exact counts of a tokenizer, which a column name then
chooses. Either way no window passes its budget without saying so.

With a budget B: a turn of over B/4 tokens ("long") is a span of its own; other
turns are cut on the grid of B/4 by their prefix sums, so a span has under B/2
tokens; history takes at most B/4. Only a long turn or a system turn of over
B/4 can push a window over B, and such a window says so in ``over_budget``.

Cases: null text and null role are empty strings; a null conversation id is a
conversation of its own; turns are ordered by (turn, role, text), null turns
first, so ties and repeated rows have one defined order and all are kept; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import null_safe_key, refuse, staged, text_or_empty
from .tokens import encode_bounded, encoder_of

START, END = "<|im_start|>", "<|im_end|>"
MARKUP = len(START + "\n" + END + "\n")
_UNESCAPE = re.compile(r"<\\(\\*)\|")
_UNESCAPE_ROLE = re.compile(r"\\(.)")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
#: A conversation is hot beyond so many bytes, or beyond a millionth of all bytes; so there are at most a million hot ones.
HOT_BYTES, MAX_HOT = 64 << 20, 1_000_000


def escape(col: Column) -> Column:
    r"""``<`` + any backslashes + ``|`` gets one more backslash: no ``<|`` is left."""
    return F.regexp_replace(col, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    if "<\\" not in text:
        return text
    return _UNESCAPE.sub(lambda m: "<" + m[1] + "|", text)


def escape_role(col: Column) -> Column:
    r"""``escape``, then ``\`` for a backslash and ``\n`` for a line break, which would end the role's header."""
    return F.replace(F.replace(escape(col), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: str) -> str:
    if "\\" not in role:
        return role
    return unescape(_UNESCAPE_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], role))


def piece(role: Column, text: Column) -> Column:
    """A turn as formatted, of escaped role and text."""
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def counted(turns: DataFrame, tokenizer_path: str, name: str = "tokens") -> DataFrame:
    """Adds ``name``: how many tokens a turn has as formatted, by a tokenizer that drops white space (see ``tokens.WordEncoder``).

    Turns end at white space, so a window has the sum of its turns.
    """
    refuse(turns.columns, name)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(tokenizer_path)
        for texts in batches:
            n = np.zeros(len(texts), np.int64)
            for i, ids, _ in encode_bounded(encoder, list(texts)):
                n[i] += len(ids)
            yield pd.Series(n)

    return turns.withColumn(name, count(piece(escape_role(text_or_empty(F.col("role"))), escape(text_or_empty(F.col("text"))))))


def _base(turns: DataFrame, tokens: str | None) -> DataFrame:
    role, text = escape_role(text_or_empty(F.col("role"))), escape(text_or_empty(F.col("text")))
    count = F.octet_length("text").cast("long") + F.octet_length("role") + MARKUP if tokens is None else F.col("tokens")
    given = [] if tokens is None else [F.greatest(F.col(tokens).cast("long"), F.lit(1)).alias("tokens")]
    said = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), null_safe_key(F.col("conv_id")).alias("conv_key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), *given,
    )
    return said.withColumn("tokens", count)


def _split(base: DataFrame, hot_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """(turns of conversations that one task may take, turns of the hot ones or None)."""
    sizes = base.groupBy("conv_key").agg(F.sum(F.octet_length("text") + F.octet_length("role") + 32).alias("b"))
    total = sizes.agg(F.sum("b").alias("b"), F.max("b").alias("most")).first()
    limit = max(hot_bytes, (total["b"] or 0) // MAX_HOT)
    if (total["most"] or 0) <= limit:
        return base, None
    hot = staged(sizes.where(F.col("b") > limit).select("conv_key"), "chat-hot")  # MAX_HOT rows at most, or total / hot_bytes
    return base.join(F.broadcast(hot), "conv_key", "left_anti"), base.join(F.broadcast(hot), "conv_key", "left_semi")


def _said(base: DataFrame) -> DataFrame:
    """Staged turns in order: seq grows with (conversation, turn, role, text), pid is the part of the order that a row is in."""
    ranged = base.repartitionByRange("conv_key", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_key", "turn", "role", "text")
    return staged(ranged.select(
        "conv_key", "conv_id", "role", "text", "tokens",
        F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("seq"),
    ), "chat-turns")


def _located(said: DataFrame, budget: int) -> DataFrame:
    """idx, start_tok and span of every turn, without its text."""
    cell = max(budget // 4, 1)
    part = said.select("conv_key", "conv_id", "pid", "seq", "tokens", (F.col("role") == "system").alias("is_system"))
    is_long = (F.col("tokens") > cell).cast("long")
    inner = Window.partitionBy("pid", "conv_key").orderBy("seq")
    sofar = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = part.withColumns({
        "idx": F.row_number().over(inner).cast("long") - 1, "end_tok": F.sum("tokens").over(sofar), "longs": F.sum(is_long).over(sofar),
    })
    before = Window.partitionBy("conv_key").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy("pid", "conv_key").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum(is_long).alias("l"))
    sums = sums.select("pid", "conv_key", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "ntl"])
    full = here.join(sums, ["pid", "conv_key"])
    return full.select(
        "conv_key", "conv_id", "seq", "is_system", "tokens", (F.col("idx") + F.col("n0")).alias("idx"),
        (F.col("end_tok") + F.col("t0") - F.col("tokens")).alias("start_tok"),
        F.struct(
            (F.col("longs") + F.col("l0")).alias("longs"), (F.col("tokens") > cell).alias("is_long"),
            F.when(F.col("tokens") > cell, F.lit(0)).otherwise(F.floor((F.col("end_tok") + F.col("t0") - 1) / cell)).cast("long").alias("cell"),
        ).alias("span"),
    )


def _hot_turns(base: DataFrame, budget: int, history_turns: int) -> DataFrame:
    """conv_key, conv_id, window_start and the turns of every window of hot conversations."""
    said = _said(base)
    located = staged(_located(said, budget), "chat-located")
    spans = located.groupBy("conv_key", "span").agg(F.min("idx").alias("window_start"), F.min("start_tok").alias("span_tok"))
    own = located.join(spans.select("conv_key", "span", "window_start"), ["conv_key", "span"]).withColumn("repeated", F.lit(False))
    wanted = spans.where("window_start > 0").withColumn(
        "idx", F.explode(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.filter(
            F.sequence(F.col("window_start") - history_turns, F.col("window_start") - 1) if history_turns else F.array().cast("array<bigint>"), lambda i: i >= 0))))
    ).drop("span")
    again = located.drop("span").join(wanted, ["conv_key", "idx"]).where(
        ((F.col("idx") == 0) & F.col("is_system"))
        | ((F.col("idx") >= F.col("window_start") - history_turns) & (F.col("span_tok") - F.col("start_tok") <= budget // 4))
    ).withColumn("repeated", F.lit(True))
    cols = ["seq", "conv_key", "conv_id", "window_start", "idx", "tokens", "repeated"]
    places = own.select(*cols).unionByName(again.select(*cols))
    # a window is one long turn, or its turns are under the budget
    return said.select("seq", "role", "text").join(places, "seq").groupBy("conv_key", "conv_id", "window_start").agg(
        F.array_sort(F.collect_list(F.struct("idx", "role", "text", "tokens", "repeated"))).alias("turns")
    )


def _turns(base: DataFrame, budget: int, history_turns: int) -> DataFrame:
    """The same for all other conversations: one shuffle, which the grouping by windows shares."""
    cell = max(budget // 4, 1)
    order = Window.partitionBy("conv_key").orderBy("turn", "role", "text")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_long = F.col("tokens") > cell
    summed = base.withColumns({
        "idx": F.row_number().over(order).cast("long") - 1, "end_tok": F.sum("tokens").over(sofar), "longs": F.sum(is_long.cast("long")).over(sofar),
    }).withColumns({
        "start_tok": F.col("end_tok") - F.col("tokens"), "span": F.struct("longs", is_long.alias("is_long"), F.when(is_long, F.lit(0)).otherwise(F.floor((F.col("end_tok") - 1) / cell)).alias("cell")),
    })
    begins = summed.withColumn("begins", (F.col("idx") == 0) | (F.col("span") != F.lag("span").over(order)))
    turn = F.struct("idx", "role", "text", "tokens", "start_tok")
    first = F.first(F.when((F.col("idx") == 0) & (F.col("role") == "system"), F.array(turn))).over(sofar)
    before = F.collect_list(turn).over(order.rowsBetween(-history_turns, -1)) if history_turns else F.array().cast("array<struct<idx:bigint,role:string,text:string,tokens:bigint,start_tok:bigint>>")
    marked = begins.withColumns({"window_start": F.max(F.when(F.col("begins"), F.col("idx"))).over(sofar), "first": first, "before": before})
    near = F.filter("before", lambda t: ((t["idx"] == 0) & (t["role"] == "system")) | (F.col("start_tok") - t["start_tok"] <= budget // 4))
    repeats = F.concat(F.when(F.col("idx") > history_turns, F.coalesce("first", F.array().cast(marked.schema["first"].dataType))).otherwise(F.array().cast(marked.schema["first"].dataType)), near)
    placed = lambda t, again: F.struct(t["idx"].alias("idx"), t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"), F.lit(again).alias("repeated"))
    held = marked.select(
        "conv_key", "conv_id", "window_start", turn.alias("own"), F.when(F.col("begins") & (F.col("idx") > 0), repeats).alias("again"),
    )
    grouped = held.groupBy("conv_key", "conv_id", "window_start").agg(F.array_sort(F.collect_list("own")).alias("own"), F.first("again", ignorenulls=True).alias("again"))
    return grouped.select("conv_key", "conv_id", "window_start", F.concat(
        F.coalesce(F.transform("again", lambda t: placed(t, True)), F.array()), F.transform("own", lambda t: placed(t, False))).alias("turns"))


def _formatted(windows: DataFrame, budget: int) -> DataFrame:
    """conv_key, conv_id, window_start, window_tokens, over_budget, n_repeated, formatted, loss_spans."""
    head = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"))
    nothing = F.array().cast("array<struct<start:int,length:int>>")

    def step(a: Column, t: Column) -> Column:
        begin, length = a["at"] + F.char_length(head(t)), F.char_length(t["text"])
        target = (t["role"] == "assistant") & ~t["repeated"]
        return F.struct(
            (begin + length + len(END) + 1).alias("at"),
            F.when(target, F.concat(a["loss"], F.array(F.struct(begin.alias("start"), length.alias("length"))))).otherwise(a["loss"]).alias("loss"),
        )

    total = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    return windows.select(
        "conv_key", "conv_id", "window_start", total.alias("window_tokens"), (total > budget).alias("over_budget"), F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"),
        F.array_join(F.transform("turns", lambda t: piece(t["role"], t["text"])), "").alias("formatted"), F.aggregate("turns", F.struct(F.lit(0).alias("at"), nothing.alias("loss")), step, lambda a: a["loss"]).alias("loss_spans"),
    )


def _both(turns: DataFrame, budget: int, history_turns: int, hot_bytes: int, tokens: str | None) -> tuple[DataFrame, DataFrame | None]:
    if budget < 4 or history_turns < 0:
        raise ValueError("budget must be 4 or more and history_turns 0 or more")
    rest, hot = _split(_base(turns, tokens), hot_bytes)
    return _formatted(_turns(rest, budget, history_turns), budget), None if hot is None else _formatted(_hot_turns(hot, budget, history_turns), budget)


def chat_windows(turns: DataFrame, budget: int = 8192, history_turns: int = 2, hot_bytes: int = HOT_BYTES, tokens: str | None = None) -> DataFrame:
    """One row per window: formatted text, loss spans (code points into it) and how many turns it repeats.

    ``turns``: conv_id, turn, role, text, and ``tokens`` if a column of counts is named. Repeated turns are the system turn (a
    conversation's first turn, if its role is system) and up to
    ``history_turns`` turns before the span, of at most budget/4 tokens.
    """
    rest, hot = _both(turns, budget, history_turns, hot_bytes, tokens)
    return rest if hot is None else rest.unionByName(hot)


def parse_window(formatted: str) -> list[tuple[str, str]]:
    """Turns (role, text) of a formatted window, unescaped."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def window_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns, loss text and their digests.

    A digest is sequential by definition, so the windows of a conversation
    stream in order through one task, one Arrow batch at a time: memory stays
    bounded, and nothing of a conversation is held.
    """
    return _digests(windows.repartition("conv_key").sortWithinPartitions("conv_key", "window_start"))


def chat_digests(turns: DataFrame, budget: int = 8192, history_turns: int = 2, hot_bytes: int = HOT_BYTES, tokens: str | None = None) -> DataFrame:
    """``window_digests`` of ``chat_windows``; windows of conversations that are not hot are read where they were made."""
    rest, hot = _both(turns, budget, history_turns, hot_bytes, tokens)
    # the row number asks for the order that is there but for a sort within tasks
    done = _digests(rest.withColumn("place", F.row_number().over(Window.partitionBy("conv_key").orderBy("window_start"))))
    return done if hot is None else done.unionByName(window_digests(hot))


def _digests(ordered: DataFrame) -> DataFrame:
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None

        def row() -> tuple:
            _, cid, n, full, chars, loss, size = state
            return cid, n, full.hexdigest(), chars, loss.hexdigest(), size

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

        for pdf in batches:
            done = []
            for key, cid, rep, text, starts, lengths in zip(pdf.conv_key, pdf.conv_id, pdf.n_repeated, pdf.formatted, pdf.starts, pdf.lengths, strict=True):
                if state is None or state[0] != key:
                    if state is not None:
                        done.append(row())
                    state = [key, None if pd.isna(cid) else int(cid), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse_window(text)[rep:]:
                    state[2] += 1
                    state[3].update(f"{role}\n{said}\n".encode())
                for start, length in zip(starts.tolist(), lengths.tolist(), strict=True):
                    said = unescape(text[start : start + length])
                    state[4] += len(said)
                    state[5].update(said.encode())
                state[6] += len(text)
            if done:
                yield frame(done)
        if state is not None:
            yield frame([row()])

    # spans as two arrays of integers: structs would reach Python one dict each
    flat = ordered.select(
        "conv_key", "conv_id", "n_repeated", "formatted", F.col("loss_spans.start").alias("starts"), F.col("loss_spans.length").alias("lengths"),
        *(c for c in ordered.columns if c == "place"),
    )
    return flat.mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
