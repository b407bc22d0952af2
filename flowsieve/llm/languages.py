"""Language identification as inference of a multilingual mixture.

Training counts hashed byte trigrams per language, over all labelled training documents. A text is cut into short
windows; each has a likelihood under every language, the sum over its trigrams. Expectation-maximisation over the
windows gives the proportions of a set of languages. The set is grown from the best single language: the language
that raises the likelihood most joins if it beats a penalty per further language that grows with the logarithm of the
number of windows. The predicted language has the largest proportion; its proportion, times the chance of the set's
language against all others for a text of few windows, is the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.text import raw_texts, slices

BITS = 15
WINDOW = 32
#: Added to every count, and the cost of a further language in units of half the log of the number of windows.
SMOOTHING = 0.5
PENALTY = 8.0
ROUNDS = 20
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: ASCII letters to lower case; digits, white space and punctuation to a space.
_LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint32)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from training; a NULL id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def trigrams(raw: bytes) -> np.ndarray:
    """Hash buckets of all byte trigrams of a text between two spaces; those of nothing but non-letters are left out."""
    a = np.full(len(raw) + 2, 32, np.uint32)
    a[1:-1] = _LETTERS[np.frombuffer(raw, np.uint8)]
    x, y, z = a[:-2], a[1:-1], a[2:]
    h = ((x << np.uint32(16)) | (y << np.uint32(8)) | z) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    return h[(y != 32) | ((x != 32) & (z != 32))]


def count_trigrams(documents: DataFrame, text: str, label: str) -> DataFrame:
    """label, bucket, n over all rows; partial counts leave a task once for each of its labels and buckets."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            for label, raw in zip(part.column("label").to_pylist(), raw_texts(part, "text")):
                if label not in totals:
                    totals[label] = np.zeros(1 << BITS, np.int64)
                totals[label] += np.bincount(trigrams(raw), minlength=1 << BITS)
        for label, n in totals.items():
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["label", "bucket", "n"]
                )

    rows = documents.select(documents[label].cast("string").alias("label"), documents[text].alias("text")).filter("label IS NOT NULL")
    return rows.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log-likelihoods of trigram buckets, one row per language. Size: languages times 2^BITS."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        n = np.array([counts[x] for x in self.languages], np.float64).reshape(len(self.languages), 1 << BITS)
        self.logs = np.log((n + SMOOTHING) / (n.sum(1, keepdims=True) + SMOOTHING * (1 << BITS))).astype(np.float32)

    def windows(self, raw: bytes) -> np.ndarray:
        """Log-likelihood of each window of ``WINDOW`` trigrams (the last may be shorter), by language."""
        h = trigrams(raw)
        return np.add.reduceat(self.logs[:, h], np.arange(0, len(h), WINDOW), axis=1).T.astype(np.float64) if len(h) else np.empty((0, len(self.languages)))

    def mixture(self, logs: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The chosen languages, their proportions, and the likelihoods of all single languages."""
        single = logs.sum(0)
        chosen, weights, best = [int(single.argmax())], np.ones(1), float(single.max())
        cost = PENALTY * 0.5 * np.log(len(logs) + 1)
        while len(chosen) < len(self.languages):
            top = logs[:, chosen].max(1)
            bound = np.maximum(logs, top[:, None]).sum(0)  # no mixture with that language can exceed it
            tries = [x for x in range(len(self.languages)) if x not in chosen and bound[x] - best > cost]
            fits = [(*expectation_maximisation(logs[:, [*chosen, x]]), x) for x in tries]
            if not fits or (winner := max(fits, key=lambda f: (f[1], -f[2])))[1] - best <= cost:
                break
            weights, best = winner[0], winner[1]
            chosen.append(winner[2])
        return chosen, weights, single

    def predict(self, raw: bytes) -> tuple[str, float, list[tuple[str, float]]]:
        """The main language, its score in 0..1, and the proportions of the chosen set."""
        if not self.languages or not has_letter(raw):
            return UNKNOWN, 0.0, []
        logs = self.windows(raw)
        chosen, weights, single = self.mixture(logs)
        at = int(weights.argmax())
        chance = 1.0
        if len(chosen) == 1:
            odds = np.exp(np.clip(single - single[chosen[0]], -700, 0))
            chance = float(1 / odds.sum())
        parts = sorted(((self.languages[c], float(w)) for c, w in zip(chosen, weights)), key=lambda p: (-p[1], p[0]))
        return self.languages[chosen[at]], float(min(1.0, weights[at] * chance)), parts


def expectation_maximisation(logs: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the columns that maximise the windows' likelihood, and that log-likelihood."""
    top = logs.max(1, keepdims=True)
    like = np.exp(np.clip(logs - top, -700, 0))
    weights = np.full(logs.shape[1], 1 / logs.shape[1])
    for _ in range(ROUNDS):
        joint = like * weights
        weights = (joint / joint.sum(1, keepdims=True)).mean(0)
    return weights, float((np.log((like * weights).sum(1)) + top[:, 0]).sum())


def has_letter(raw: bytes) -> bool:
    """Whether a text has a Unicode letter."""
    return bool(_ASCII_LETTER.search(raw)) or not raw.isascii() and any(c.isalpha() for c in raw.decode())


def train(documents: DataFrame, text: str = "text", label: str = "lang") -> LanguageModel:
    """A model of all rows with a label. NULL texts add nothing, yet their label is learned."""
    counts: dict[str, np.ndarray] = {}
    for r in documents.select(documents[label].cast("string").alias("label")).filter("label IS NOT NULL").distinct().collect():
        counts[r[0]] = np.zeros(1 << BITS, np.int64)
    for r in count_trigrams(documents, text, label).groupBy("label").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).collect():
        counts[r[0]][[c[0] for c in r[1]]] = [c[1] for c in r[1]]
    return LanguageModel(counts)


def identify(documents: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, proportions (language, share): one row per document row.

    Texts that are NULL or without a letter are ``und`` with score 0, as is every text if no language was learned.
    Whole texts are read, of any length; ids may be NULL or repeated; ties go to the first language by name. Only
    the two named columns are read; no shuffle.
    """
    shares = pa.list_(pa.struct([("language", pa.string()), ("share", pa.float64())]))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [model.predict(raw) for raw in raw_texts(part, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([[{"language": x, "share": s} for x, s in f[2]] for f in found], shares),
                ],
                names=["doc_id", "lang_pred", "score", "proportions"],
            )

    share = T.StructType().add("language", T.StringType()).add("share", T.DoubleType())
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema[doc_id].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("proportions", T.ArrayType(share)),
        ]
    )
    return documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text")).mapInArrow(predict, schema)


def keep_identified(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents with a letter, all columns; ``lang``, where there is one, becomes the predicted language.

    Labels give way to the prediction, right or wrong. If no language was learned all are ``und`` and none is left;
    ``keep_letters`` is for that case.
    """

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [model.predict(raw)[0] for raw in raw_texts(part, "text")]
            if "lang" in part.schema.names:
                at = part.schema.get_field_index("lang")
                part = part.set_column(at, part.schema.field(at), pa.array(found, pa.string()).cast(part.schema.field(at).type))
            yield part.filter(pa.array([x != UNKNOWN for x in found], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)


def keep_letters(documents: DataFrame) -> DataFrame:
    """The documents with a letter, as they are."""

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield part.filter(pa.array([has_letter(raw) for raw in raw_texts(part, "text")], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)


def in_training(doc_id: object, folds: int) -> bool:
    """The fold rule on one id, as the tests use it."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds != 0
