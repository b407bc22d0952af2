"""Scoring with a log-bilinear language model trained by noise-contrastive estimation.

Counts come from all training texts. The most frequent words are classes of their own; every other word, known or
not, belongs to a class by its ending, so a token's probability is that of its class after the class before, times the
smoothed share of the word in its class. The class model is log-bilinear: a context vector, mapped by a matrix, meets
an output vector and a bias. It is trained in numpy on the table of class pairs of all training tokens, which is what
the estimation needs of the corpus, with the noise expectation taken exactly. One batched matrix product then gives
the scores of all contexts, normalised over all classes, so the probabilities of all words and of the unknown add up
to one. Scoring looks up class pairs; counts of words outside the shipped head come by a join on the word.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.text import raw_texts, slices, space_words
from flowsieve.session import materialise

#: The end of a text as a token; no word holds a space.
END = b" "
#: Words with a class of their own, classes by ending, bytes of an ending, dimensions, noise per token, steps.
FREQUENT, ENDINGS, ENDING_BYTES, DIMENSIONS, NOISE, STEPS = 1000, 63, 3, 48, 10, 200
#: Most frequent words whose counts go to every task, at most this many and this long; the rest are joined.
HEAD_WORDS, HEAD_BYTES = 120_000, 48
ALPHA = 0.1
#: Distinct words that a counting task holds before it passes them on.
PARTIAL_WORDS = 600_000


def held_out(doc_id: Column, folds: int = 10) -> Column:
    """Whether a text is kept from training; a NULL id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def count_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """word (bytes), n over all texts, with the end of each text as a word."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64())], names=["word", "n"])

        for part in slices(batches, "text"):
            for raw in raw_texts(part, "text"):
                n.update(space_words(raw))
            n[END] += part.num_rows
            if len(n) > PARTIAL_WORDS:
                yield out()
                n = Counter()
        if n:
            yield out()

    rows = documents.select(documents[text].alias("text")).mapInArrow(count, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def ending_class(word: bytes) -> int:
    return zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS


@dataclass
class Vocabulary:
    """The head of the word counts, and the totals of all words and of the classes by ending."""

    words: list[bytes]  # the first ``frequent`` are classes of their own, END is the very first
    counts: np.ndarray
    frequent: int
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_distinct: np.ndarray

    @property
    def classes(self) -> int:
        return self.frequent + ENDINGS

    @property
    def base_cost(self) -> float:
        return math.log10(self.tokens + ALPHA * (self.distinct + 1))

    def tables(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of head words; their class, base and share in the class (log10); log10 size of each ending's class."""
        size = np.log10(self.class_tokens + ALPHA * (self.class_distinct + 1))
        own = np.arange(len(self.words))
        cls = np.array([i if i < self.frequent else self.frequent + ending_class(w) for i, w in enumerate(self.words)], np.int32)
        base = np.log10(self.counts + ALPHA) - self.base_cost
        share = np.where(own < self.frequent, 0.0, np.log10(self.counts + ALPHA) - size[np.maximum(cls - self.frequent, 0)])
        return {w: i for i, w in enumerate(self.words)}, cls, base, share, size


def vocabulary(counts: DataFrame, head_words: int = HEAD_WORDS) -> Vocabulary:
    """The head is every word above a count that at most ``head_words`` words reach, so its size is bounded."""
    level = F.floor(F.log2("n") * 16)
    by_level = counts.groupBy(level.alias("level")).count().collect()
    lowest, total = None, 0
    for r in sorted(by_level, reverse=True):
        total += r["count"]
        if total > head_words:
            break
        lowest = r["level"]
    head = [] if lowest is None else counts.filter((level >= lowest) & (F.octet_length("word") <= HEAD_BYTES)).collect()
    sizes = sorted(((r["n"], bytes(r["word"])) for r in head if bytes(r["word"]) != END), key=lambda x: (-x[0], x[1]))
    ending = F.crc32(F.substring(F.col("word"), -ENDING_BYTES, ENDING_BYTES)) % ENDINGS
    by_class = counts.groupBy((F.col("word") == END).alias("end"), ending.alias("c")).agg(F.sum("n"), F.count("*")).collect()
    tokens, distinct = np.zeros(ENDINGS), np.zeros(ENDINGS)
    end = next((r[2] for r in by_class if r["end"]), 0)
    for r in by_class:
        if not r["end"]:
            tokens[r["c"]], distinct[r["c"]] = r[2], r[3]
    all_tokens, all_distinct = int(tokens.sum()) + end, int(distinct.sum()) + bool(end)
    for n, w in sizes[:FREQUENT]:
        tokens[ending_class(w)] -= n
        distinct[ending_class(w)] -= 1
    words = [END, *(w for _, w in sizes)]
    n = np.array([end, *(n for n, _ in sizes)], np.float64)
    return Vocabulary(words, n, 1 + min(FREQUENT, len(sizes)), all_tokens, all_distinct, tokens, distinct)


class Encoder:
    """Texts as head indices and classes, a slice of texts at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.index, self.cls, self.base, self.share, self.size = vocabulary.tables()
        self.known = vocabulary.counts > 0  # all but the end, where nothing was learned
        self.frequent, self.classes = vocabulary.frequent, vocabulary.classes

    def encode(self, raws: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, starts of texts, head index (-1: none), class, class before (``classes`` at a start)."""
        tokens: list[bytes] = []
        starts = np.empty(len(raws), np.int64)
        for i, raw in enumerate(raws):
            starts[i] = len(tokens)
            tokens += space_words(raw)
            tokens.append(END)
        at = np.fromiter(map(self.index.get, tokens, repeat(-1)), np.int32, len(tokens))
        cls = self.cls[at]
        for i in np.flatnonzero(at < 0).tolist():
            cls[i] = self.frequent + zlib.crc32(tokens[i][-ENDING_BYTES:]) % ENDINGS
        before = np.concatenate(([self.classes], cls[:-1]))
        before[starts] = self.classes
        return tokens, starts, at, cls, before


def count_class_pairs(documents: DataFrame, vocab, text: str = "text") -> np.ndarray:
    """Pairs (class before, class) of all texts as a table; its size depends on the number of classes alone."""
    size = vocab.value.classes

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = Encoder(vocab.value), np.zeros((size + 1) * size, np.int64)
        for part in slices(batches, "text"):
            _, _, _, cls, before = encoder.encode(raw_texts(part, "text"))
            total += np.bincount(before.astype(np.int64) * size + cls, minlength=len(total))
        at = np.flatnonzero(total)
        for a in range(0, len(at), 100_000):
            part = at[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["pair", "n"])

    rows = documents.select(documents[text].alias("text")).mapInArrow(count, "pair int, n long")
    got = rows.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((size + 1) * size)
    table[got["pair"].to_numpy()] = got["n"].to_numpy()
    return table.reshape(size + 1, size)


def train_log_bilinear(pairs: np.ndarray, dimensions: int = DIMENSIONS, noise: int = NOISE, steps: int = STEPS, seed: int = 5) -> np.ndarray:
    """Natural log-probabilities of every class after every class, from noise-contrastive estimation on pair counts.

    The score of class w after class c is (r_c M) q_w + b_w. Real pairs are told from noise drawn from the class
    frequencies, ``noise`` for each; Adam ascends the whole objective. The scores are then normalised.
    """
    pairs = (pairs / max(pairs.sum(), 1)).astype(np.float32)
    contexts, classes = pairs.shape
    prior = (pairs.sum(0) + 1e-7) / (pairs.sum() + 1e-7 * classes)
    weight = pairs.sum(1, keepdims=True)
    rng = np.random.default_rng(seed)
    shape = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    params = [shape(contexts, dimensions), np.eye(dimensions, dtype=np.float32), shape(classes, dimensions), np.log(prior).astype(np.float32)]
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    offset, drawn = np.log(noise * prior).astype(np.float32), (noise * weight * prior).astype(np.float32)
    for step in range(1, steps + 1):
        r, m, q, b = params
        mapped = r @ m
        real = 1 / (1 + np.exp(np.clip(offset - (mapped @ q.T + b), -60, 60)))
        g = pairs * (1 - real) - drawn * real
        back = g @ q
        for i, grad in enumerate((back @ m.T, r.T @ back, g.T @ mapped, g.sum(0))):
            moment[i] = 0.9 * moment[i] + 0.1 * grad
            square[i] = 0.99 * square[i] + 0.01 * grad * grad
            rate = 0.1 * (1 - step / (steps + 1)) + 0.002
            params[i] += rate * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-12)
    r, m, q, b = params
    scores = ((r @ m) @ q.T + b).astype(np.float64)
    top = scores.max(1, keepdims=True)
    return (scores - top - np.log(np.exp(scores - top).sum(1, keepdims=True))).astype(np.float32)


def score_texts(documents: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per row, learned where ``training`` holds.

    ``base_score`` is the smoothed unigram log10 probability, ``score`` that of the model. A text is its words between
    ASCII white space, A-Z lowered, and one end; NULL and empty texts are just the end. Ids may be NULL or repeated;
    only the two named columns are read. Without training texts every word is unknown and all are equally likely.
    """
    spark = documents.sparkSession
    docs = documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text"), training.alias("_train"))
    taught = docs.filter("_train")
    counts = materialise(count_words(taught), "word-counts")
    vocab = vocabulary(counts)
    shipped = spark.sparkContext.broadcast(vocab)
    table = spark.sparkContext.broadcast(train_log_bilinear(count_class_pairs(taught, shipped)) / np.float32(math.log(10)))
    tail = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())]))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, logs, cost = Encoder(shipped.value), table.value, shipped.value.base_cost
        key = TaskContext.get().partitionId() << 40
        for part in slices(batches, "text"):
            tokens, starts, at, cls, before = encoder.encode(raw_texts(part, "text"))
            lost = at < 0
            ending = np.where(lost, cls - encoder.frequent, 0)
            base = np.where(lost, -cost, encoder.base[at])
            own = logs[before, cls] + np.where(lost, -encoder.size[ending], encoder.share[at])
            missing = np.flatnonzero(lost)
            edges = np.searchsorted(missing, [*starts, len(tokens)])
            missing, offsets, words, times = missing.tolist(), [0], [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                n = Counter([tokens[i] for i in missing[a:b]])
                words += n.keys()
                times += n.values()
                offsets.append(len(words))
            pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int32())], names=["word", "tf"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(key, key + part.num_rows)),
                    part.column("doc_id"),
                    pa.array(np.diff(np.append(starts, len(tokens)))),
                    pa.array(np.add.reduceat((~lost & encoder.known[at]).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(own.astype(np.float64), starts)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs).cast(tail),
                ],
                names=["key", "doc_id", "n_tokens", "n_known", "base_score", "score", "tail"],
            )
            key += part.num_rows

    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"key long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, tail array<struct<word:binary,tf:int>>"
    scored = materialise(docs.select("doc_id", "text").mapInArrow(score, schema), "scored-texts")
    words = scored.select("key", F.explode("tail").alias("t")).select("key", "t.word", "t.tf")
    n = F.coalesce("n", F.lit(0))
    late = (
        words.join(counts, "word", "left")
        .groupBy("key")
        .agg(F.sum(F.col("tf") * F.log10(n + ALPHA)).alias("late"), F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("late_known"))
    )
    late_score = F.coalesce("late", F.lit(0.0))
    return scored.drop("tail").join(late, "key", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + late_score).alias("base_score"),
        (F.col("score") + late_score).alias("score"),
    )

