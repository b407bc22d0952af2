"""Token counts without token ids: pieces are counted once per distinct pre-token and multiplied by frequencies.

A text falls into units: a word with the space before it, or a word at the start of a line, or a line break. The
tokenizer's own pre-tokenizer never merges across such units, so a text's tokens are the sum over its distinct units
of frequency times pieces. Texts with runs of white space or special strings are cut by the tokenizer's
pre-tokenizer instead, with the same sum. The pieces of a unit depend on the unit alone, so each task keeps its own
table of the units it has met: a table shared by all tasks would need a shuffle of about 0.6 rows per word.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowsieve.llm.text import slices, texts

#: Units that a task remembers; beyond, its table starts anew. Bounds memory, never the result.
MEMO_UNITS = 400_000


class PieceCounts:
    """Pieces per distinct unit under a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not plain:
            raise ValueError("only byte-level tokenizers without normaliser and prefix space can be summed by unit")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pieces: dict[str, int] = {}

    def units(self, text: str) -> Counter | None:
        """Frequencies of the units, or None where white space runs need the pre-tokenizer."""
        found: list[str] = []
        lines = text.split("\n")
        for line in lines:
            words = line.split(" ")
            for w in words:
                if not w or w[0].isspace() or w[-1].isspace() or w[0] in "\x1c\x1d\x1e\x1f" or w[-1] in "\x1c\x1d\x1e\x1f":
                    return None
            found.append(words[0])
            found.extend([f" {w}" for w in words[1:]])
        counts = Counter(found)
        if len(lines) > 1:
            counts["\n"] += len(lines) - 1
        return counts

    def cut(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the pre-tokens and the number of special strings."""
        parts, special = [text], 0
        for s in self.special:
            cut = [p.split(s) for p in parts]
            special += sum(len(p) - 1 for p in cut)
            parts = [x for p in cut for x in p]
        counts: Counter = Counter()
        for p in parts:
            counts.update(p[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(p))
        return counts, special

    def count(self, batch: list[str]) -> list[int]:
        """Tokens of each text."""
        frequencies = []
        for text in batch:
            if not text:
                frequencies.append((Counter(), 0))
                continue
            units = None if any(s in text for s in self.special) else self.units(text)
            frequencies.append(self.cut(text) if units is None else (units, 0))
        if len(self.pieces) > MEMO_UNITS:
            self.pieces = {}
        new = list(set().union(*(f for f, _ in frequencies)) - self.pieces.keys())
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            self.pieces.update(zip(part, map(len, self.tokenizer.encode_batch(part, add_special_tokens=False))))
        pieces = self.pieces
        return [special + sum([pieces[u] * n for u, n in f.items()]) for f, special in frequencies]


def count_tokens(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """UTF-8 bytes and tokens of each text, and whether they are more than ``limit``: one row per row.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read. NULL and empty texts have no
    bytes and no tokens; a NULL id stays NULL; repeated rows stay; columns other than id and text are not read. No
    shuffle: counts are exact for texts of any length, with memory for one slice of texts and a bounded table.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema[doc_id].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounts(tokenizer)
        for part in slices(batches, "text"):
            n = counter.count(texts(part, "text"))
            size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=schema.names,
            )

    return documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text")).mapInArrow(count, schema)
