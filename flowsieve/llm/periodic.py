"""Periodic runs of words in a text, by an online sparse dynamic programme over diagonals.

A diagonal is a lag: the words of a text against the words ``lag`` places earlier. Going through a text, each word's
earlier occurrences lengthen the match of their lags by one; a lag that no occurrence continues ends, and a run is
given out at once if its match was long enough. Two facts keep the number of occurrences small without losing a run:

- A run of period q has a match of at least max(q, min_length - q) words. So a word counts as met again only together
  with the words that follow it: ``ceil(min_length / 2)`` words for small lags, then twice as many for lags twice as
  large, and so on. Such stretches are told apart by exact ranks built from the ranks of their halves, and only
  stretches that occur again go on to the next scale, so ordinary prose drops out after a few words.
- A stretch inside a run of a period of at most half its length can meet itself in that run only at multiples of the
  period, which are the same run again. Occurrences inside that run are passed over, so one word repeated a million
  times costs no more than its length for each scale.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowsieve.llm.text import raw_texts, slices

MIN_LENGTH, MIN_REPEATS = 12, 2
#: Occurrences that are listed at a time.
PIECE = 1 << 20
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


class Stretches:
    """Ranks of the stretches of ``length`` words of a text that occur more than once; -1 for all others."""

    def __init__(self, length: int, rank: np.ndarray):
        self.length, self.rank = length, rank

    @classmethod
    def of_words(cls, ids: np.ndarray) -> Stretches:
        return cls(1, np.where(np.bincount(ids)[ids] > 1, ids, -1) if len(ids) else ids)

    def longer(self, other: Stretches) -> Stretches:
        """Stretches of both lengths together: this one, then the other."""
        rank = np.full(len(self.rank), -1, np.int64)
        at = np.flatnonzero(self.rank[: max(0, len(rank) - self.length)] >= 0)
        at = at[other.rank[at + self.length] >= 0]
        if len(at):
            pairs = self.rank[at] * (int(other.rank.max()) + 1) + other.rank[at + self.length]
            _, which, counts = np.unique(pairs, return_inverse=True, return_counts=True)
            again = counts[which] > 1
            rank[at[again]] = which[again]
        return Stretches(self.length + other.length, rank)

    def found(self) -> bool:
        return bool((self.rank >= 0).any())


def _stretches(ids: np.ndarray, length: int) -> Stretches:
    """Stretches of any length, put together from those of powers of two."""
    power, out = Stretches.of_words(ids), None
    while True:
        if length & 1:
            out = power if out is None else out.longer(power)
        length >>= 1
        if not length or not power.found():
            # Without a repeated part there is no repeated whole.
            return out if not length else Stretches(power.length, np.full(len(ids), -1, np.int64))
        power = power.longer(power)


def _occurrences(now: Stretches, low: int, high: int, inside: np.ndarray) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """(places, first, last): the earlier occurrences of each place, as lags ``low`` to ``high`` - 1, in pieces.

    ``inside`` is the start of the run of a small period that the whole stretch lies in, or the text's length: only
    occurrences before it count.
    """
    n = len(now.rank)
    at = np.flatnonzero(now.rank >= 0)
    keys = np.sort(now.rank[at] * (n + 1) + at)
    base = now.rank[at] * (n + 1)
    first = np.searchsorted(keys, base + np.maximum(at - high + 1, 0))
    last = np.searchsorted(keys, base + np.minimum(at - low, inside[at] - 1), side="right")
    many = np.flatnonzero(last > first)
    at, first, last = at[many], first[many], last[many]
    upto = np.cumsum(last - first)
    cuts = np.searchsorted(upto, np.arange(PIECE, int(upto[-1]) if len(upto) else 0, PIECE)).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(at)]):
        if a == b:
            continue
        sizes = last[a:b] - first[a:b]
        ends = np.cumsum(sizes)
        pick = np.arange(int(ends[-1])) + np.repeat(first[a:b] - (ends - sizes), sizes)
        lags = np.repeat(at[a:b], sizes) - keys[pick] % (n + 1)
        yield at[a:b].tolist(), ends.tolist(), lags.tolist()


def runs_of(words: list, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period.

    A run is a stretch that no neighbour extends, with its smallest period q and max(min_length, min_repeats * q)
    words or more. ``min_repeats`` is 2 at least: below that a stretch can have several periods of its own.
    """
    if min_repeats < 2 or min_length < 2:
        raise ValueError("a run repeats its period at least once")
    n, seen = len(words), {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    now = _stretches(ids, -(-min_length // 2))
    low, high = 1, 2 * now.length
    found: dict[tuple[int, int], int] = {}
    while now.found() and low <= n // min_repeats:
        g = now.length
        inside = np.full(n, n, np.int64)
        for (start, length), period in found.items():
            if 2 * period <= g <= length:
                inside[start : start + length - g + 1] = start
        active: dict[int, int] = {}
        before = -2

        def ended(lags: dict[int, int], last: int) -> None:
            for q, met in lags.items():
                length = met + g - 1 + q
                if length >= min_length and length >= min_repeats * q:
                    # A lag that is a multiple of the period ends the same stretch.
                    key = (last - met + 1 - q, length)
                    found[key] = min(q, found.get(key, q))

        for places, ends, lags in _occurrences(now, low, high, inside):
            a = 0
            for i, b in zip(places, ends):
                if i != before + 1 and active:
                    ended(active, before)
                    active = {}
                grown = {q: active.pop(q, 0) + 1 for q in lags[a:b]}
                if active:
                    ended(active, before)
                active, before, a = grown, i, b
        ended(active, before)
        now = now.longer(now)
        low, high = now.length, 2 * now.length
    return sorted((start, length, q) for (start, length), q in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()
    return [words[i] for i in kept]


def find_runs(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS
) -> DataFrame:
    """doc_id, n_words long, runs array<struct<start, length, period>>, collapsed string: one row per row.

    Words lie between ASCII white space (0x20, 0x09-0x0D) and are told apart as they are written. Runs are ordered by
    start, then period; ``collapsed`` holds the kept words joined by one space. NULL, empty and blank texts have no
    words, no runs and an empty ``collapsed``; a NULL id stays NULL; repeated rows stay; an empty table gives an empty
    one; columns other than id and text are not read. A row is judged by itself, so nothing is shuffled. A text is held
    whole in one task, with some fifty bytes for each of its words.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema[doc_id].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(RUN)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    out = to_arrow_schema(schema)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sizes, found, kept = [], [], []
            for raw in raw_texts(part, "text"):
                words = raw.split()
                runs = runs_of(words, min_length, min_repeats)
                sizes.append(len(words))
                found.append(runs)
                kept.append(b" ".join(collapsed(words, runs)))
            columns = [pa.array(c, kind) for c, kind in zip((sizes, found, kept), (pa.int64(), out.field("runs").type, pa.binary()))]
            columns[-1] = columns[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], schema=out)

    return documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text")).mapInArrow(scan, schema)


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and SHA-256 of all runs and of what is kept."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("run"))))["run"]
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    ended = F.array_join(F.transform(line, lambda s: F.concat(s, F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), ended.alias("l"), "collapsed").select(
        "doc_id",
        "n_runs",
        *[F.col(f"r.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("r.length") / F.col("r.period")).cast("long").alias("exponent_milli"),
        F.sha2("l", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_repeated_tails(documents: DataFrame) -> DataFrame:
    """(doc_id, text): the texts, one in ten of them with a tail that repeats: h = crc32 of the id in decimal.

    If h % 10 is 0, each word from a = (h // 10) % n on becomes the word at a + (i - a) % p, p = 1 + (n - a) // (3 +
    (h // 10) % 8). All other texts, those of NULL ids and those without words stay as they are.
    """
    schema = T.StructType([documents.schema["doc_id"], T.StructField("h", T.LongType()), T.StructField("text", T.StringType())])

    def repeat(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            marks = batch.column("h").to_pylist()
            if any(h is not None and h % 10 == 0 for h in marks):
                made = []
                for h, raw in zip(marks, texts.cast(pa.binary()).to_pylist()):
                    words = raw.split() if raw and h is not None and h % 10 == 0 else []
                    if words:
                        n, g = len(words), h // 10
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        raw = b" ".join([*words[:a], *(words[a + i % p] for i in range(n - a))])
                    made.append(raw)
                texts = pa.array(made, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), texts], names=schema.names)

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return documents.select("doc_id", h.alias("h"), "text").mapInArrow(repeat, schema).drop("h")
