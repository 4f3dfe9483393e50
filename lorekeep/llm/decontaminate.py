"""Benchmark decontamination with one Aho-Corasick automaton.

Items (questions and answers) are cut into windows of consecutive words; all
distinct windows form one automaton over normalised text. A document is
normalised, scanned once, and the hits are mapped to its words and to offsets of
the original text.

The windows are made in Spark and staged. An automaton has about ``MAX_NODES``
nodes at most, which take some 50 bytes each; windows beyond that are dealt by
hash to further automata. Each is brought to the driver and broadcast by itself.
A task with one automaton takes batch after batch; with more it gathers texts of
``CHUNK`` bytes, and each automaton in turn scans all of them, so that automata
are built once a chunk and one at a time is held. The hits are united by row, so
results are whole for a benchmark of any size.

Cases: null and empty texts have no words and no hits; an item without words has
no window; an item of fewer words than a window is one window; items that share
a text are all reported; repeated rows get equal results; null ids are kept (a
null item id is reported as the text ``null``); texts of any length are scanned
whole; columns that are not asked for are ignored (``decontaminate`` keeps all),
and kept columns named like a result are refused; empty tables give empty or
clean results.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, fresh_path, refuse, spread

#: MAX_NODES: bytes of windows an automaton; ITEMS: items of one window that count together.
WINDOW, MAX_NODES, ITEMS, CHUNK = 10, 3_000_000, 10_000, 32 << 20
#: Bytes of words are digits, letters (A-Z are lower-cased first) and all of UTF-8 beyond ASCII.
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RESULTS = ("n_words", "n_hit", "items", "spans")


def normalised_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_TABLE).split()


def item_windows(words: list[bytes], width: int = WINDOW) -> list[bytes]:
    """Normalised windows with a blank at either end, so that they match whole words."""
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(len(words) - width, 0) + 1)]


class Automaton:
    """``windows``: pairs of a window and its items (place, id)."""

    def __init__(self, windows: list[tuple[bytes, list[tuple]]]):
        self.machine = ahocorasick.Automaton()
        for w, items in windows:
            # a window whose many items were cut apart may come more than once
            word = bytes(w).decode("latin-1")
            had = self.machine.get(word, None)
            self.machine.add_word(word, (word.count(" ") - 1, items if had is None else had[1] + items))
        if windows:
            self.machine.make_automaton()
        self.empty = not windows

    def scan(self, text: str, hit: np.ndarray, items: set) -> None:
        """Marks the words that are hit and adds the items with a hit; ``text``: normalised words, a blank before and after each."""
        if self.empty or not len(hit):
            return
        found = [(end, n, own) for end, (n, own) in self.machine.iter(text)]
        if found:
            blanks = np.nonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 0x20)[0]
            last = np.searchsorted(blanks, [end for end, _, _ in found])  # a match ends on the blank after its last word
            for e, (_, n, own) in zip(last.tolist(), found, strict=True):
                hit[e - n : e] = True
                items.update(own)


_built: dict[tuple[str, int], Automaton] = {}


def automaton(run: str, k: int, windows: Broadcast) -> Automaton:
    """The k-th automaton of a run. A worker keeps the last one it built for its later tasks and batches."""
    if (run, k) not in _built:
        _built.clear()
        _built[run, k] = Automaton(windows.value)
        windows.__dict__.pop("_value", None)  # the automaton has them
    return _built[run, k]


def scan_texts(texts: list, run: str, windows: list[Broadcast]) -> tuple[list[np.ndarray], list[set]]:
    """(words hit, items (place, id)) of every text."""
    words = [normalised_words(t) if isinstance(t, str) else [] for t in texts]
    hits = [np.zeros(len(w), bool) for w in words]
    words = [(b" " + b" ".join(w) + b" ").decode("latin-1") for w in words]
    items: list[set] = [set() for _ in words]
    for k in range(len(windows)):
        machine = automaton(run, k, windows[k])
        for text, hit, own in zip(words, hits, items, strict=True):
            machine.scan(text, hit, own)
    return hits, items


def chunks(batches: Iterator, text_of, one: bool) -> Iterator[list]:
    """Lists of batches: of one each, or of about CHUNK bytes of text."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += sum(len(t) for t in text_of(b) if isinstance(t, str))
        if one or size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Maximal runs of hit words as code point offsets [start, end) into the text."""
    raw = text.encode("utf-8", "surrogatepass")
    bounds = [m.span() for m in _WORD.finditer(raw.lower())]
    edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    chars = lambda at: len(raw[:at].decode("utf-8", "surrogatepass"))
    return [{"start": chars(bounds[a][0]), "end": chars(bounds[b - 1][1])} for a, b in zip(np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0], strict=True)]


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> list[Broadcast]:
    """The distinct windows and their items, broadcast in parts of about MAX_NODES bytes."""
    spark, kind = benchmark.sparkSession, benchmark.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(w, p, i) for p, i, t in zip(pdf.place, pdf.item, pdf.text, strict=True) if isinstance(t, str) for w in dict.fromkeys(item_windows(normalised_words(t), width))]
            yield pd.DataFrame(found, columns=["w", "place", "item"]).astype({"w": object, "place": "int64"})

    # an item is known by its place, so that two items of one id stay two
    placed = benchmark.select(F.monotonically_increasing_id().alias("place"), F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    rows = placed.mapInPandas(cut, "w binary, place long, item string")
    # items of a common window are cut into lists of bounded length
    lists = max(-(-benchmark.count() // ITEMS), 1)
    grouped = rows.groupBy("w", F.pmod(F.xxhash64("place"), F.lit(lists)).alias("part")).agg(F.collect_list(F.struct("place", "item")).alias("items"))
    path = fresh_path(spark, "windows")
    grouped.select("w", "items", (F.length("w") + 24 * F.size("items")).cast("long").alias("size")).write.parquet(path)
    windows = spark.read.parquet(path)
    total = windows.agg(F.sum("size").alias("s")).first()["s"] or 0
    n = -(-total // MAX_NODES)
    if n > 1:
        path = fresh_path(spark, "windows")
        windows.withColumn("k", F.pmod(F.xxhash64("w"), F.lit(n))).repartition("k").write.partitionBy("k").parquet(path)
        windows = spark.read.parquet(path)
    out = []
    for k in range(max(n, 1)):
        mine = windows if n <= 1 else windows.where(F.col("k") == k)
        out.append(spark.sparkContext.broadcast([(bytes(r["w"]), [_item(i["place"], i["item"], kind) for i in r["items"]]) for r in mine.select("w", "items").collect()]))  # bounded by MAX_NODES
    return out


def _item(place: int, item: str | None, kind: str) -> tuple:
    return place, int(item) if item is not None and kind in ("tinyint", "smallint", "int", "bigint") else item


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, n_words, n_hit, items (item ids) and spans (offsets into the text) per document."""
    refuse(keep, *RESULTS)
    shared, mark = benchmark_windows(benchmark, width), uuid.uuid4().hex
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items_of = kind if kind in ("tinyint", "smallint", "int", "bigint") else "string"
    names = [f"k{i}" for i in range(len(keep))]  # inside, so that no name of a column matters
    schema = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)), f"n_words long, n_hit long, items array<{items_of}>, spans array<struct<start:int,end:int>>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in chunks(batches, lambda b: b.text, len(shared) == 1):
            pdf = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            texts = list(pdf.pop("text"))
            hits, items = scan_texts(texts, mark, shared)
            yield pdf.assign(
                n_words=[len(h) for h in hits], n_hit=[int(h.sum()) for h in hits], items=[[i for _, i in sorted(s, key=lambda x: x[0])] for s in items],
                spans=[original_spans(t, h) if h.any() else [] for t, h in zip(texts, hits, strict=True)],
            )

    wanted = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)], F.col("text").cast("string").alias("text"))
    found = spread(wanted).mapInPandas(run, schema)
    return found.toDF(*keep, *RESULTS)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated from ``contamination``."""
    names = F.array_sort(F.transform("items", lambda i: F.coalesce(i.cast("string"), F.lit("null"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents without a hit, with all their columns; rows are judged where they are, nothing is shuffled."""
    shared, mark = benchmark_windows(benchmark, width), uuid.uuid4().hex
    name = fresh_name(docs, "hit")

    @F.pandas_udf("boolean")
    def is_hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for held in chunks(batches, lambda b: b, len(shared) == 1):
            for own in held if len(shared) == 1 else [pd.concat(held, ignore_index=True)]:
                found = pd.Series([bool(h.any()) for h in scan_texts(list(own), mark, shared)[0]], dtype=bool)
                at = 0
                for b in held:  # as many rows come out as went in, batch by batch
                    yield found.iloc[at : at + len(b)]
                    at += len(b)

    return spread(docs).withColumn(name, is_hit(F.col("text").cast("string"))).where(~F.col(name)).drop(name)
