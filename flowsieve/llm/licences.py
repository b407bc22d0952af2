"""License scans: known phrases, and an exact set-similarity join of text blocks with license templates.

A text is cut into overlapping blocks of words: for each template at least twice its words long, every half a block, so
wherever a template stands in a text, one block holds it whole. A template matches a block that holds at least the
threshold share of its distinct tokens, among them those that name the license. Template tokens are ordered by how many
documents of the corpus have them, rarest first. With overlap ``o`` needed of ``m`` tokens, a matching block must hold
one of the first ``m - o + 1`` (prefix filter), must have ``o`` words (length filter), and after the token at place ``i``
enough tokens must be left (positional filter). Only blocks that pass are compared, so the filters lose nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.text import plain_words, raw_texts, slices

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices and paragraphs as licenses print them, with their label and the words that name the license.
TEMPLATES = {
    "Released under the MIT License": ("mit", "mit"),
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": ("mit", "obtaining"),
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
    whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
    notice shall be included in all copies or substantial portions of the Software.""": ("mit", "sublicense"),
    "Licensed under the Apache License, Version 2.0": ("apache", "apache"),
    "You may obtain a copy of the License at http www apache org licenses LICENSE-2.0": ("apache", "apache"),
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
    License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
    law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
    OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
    limitations under the License.""": ("apache", "apache"),
    "This work is licensed under the GNU General Public License, version 3": ("gpl", "gnu general"),
    "under the terms of the GNU General Public License as published by the Free Software Foundation": ("gpl", "gnu general"),
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
    as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
    program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""": ("gpl", "gnu general"),
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": ("lgpl", "gnu lesser"),
    "under the terms of the GNU Affero General Public License as published by the Free Software Foundation": ("agpl", "gnu affero"),
    "Redistribution and use in source and binary forms, with or without modification, are permitted": ("bsd", "redistribution binary"),
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
    following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
    the following disclaimer in the documentation and/or other materials provided with the distribution.""": ("bsd", "redistributions binary"),
    """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
    derived from this software without specific prior written permission.""": ("bsd", "endorse contributors"),
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
    provided that the above copyright notice and this permission notice appear in all copies.""": ("isc", "fee"),
    """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""": ("mpl", "mozilla mpl"),
    "Licensed under the Mozilla Public License, Version 2.0": ("mpl", "mozilla"),
    "Released under the BSD License": ("bsd", "bsd"),
    "Licensed under CC BY-NC 4.0": ("cc", "cc by nc"),
    "This work is licensed under a Creative Commons Attribution 4.0 International License": ("cc", "creative commons"),
}
#: Least words of a block.
BLOCK = 64


def block_words(notice: str) -> int:
    """The length of a template's blocks: a power of two, at least twice its words."""
    return max(BLOCK, 1 << (2 * len(plain_words(notice.encode())) - 1).bit_length())


class Templates:
    """Token sets in global order, with the overlap each needs."""

    def __init__(self, templates: dict[str, tuple[str, str]], threshold: float, frequency: dict[bytes, int]):
        self.rows = []
        for notice, (label, naming) in templates.items():
            tokens = sorted(set(plain_words(notice.encode())), key=lambda t: (frequency.get(t, 0), t))
            need = math.ceil(threshold * len(tokens) - 1e-9)
            self.rows.append((tokens, label, need, frozenset(plain_words(naming.encode()))))
        #: For each block length: the places of prefix tokens in the templates.
        self.by_prefix: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for t, (notice, (tokens, _, need, _)) in enumerate(zip(templates, self.rows)):
            places = self.by_prefix.setdefault(block_words(notice), {})
            for place, token in enumerate(tokens[: len(tokens) - need + 1]):
                places.setdefault(token, []).append((t, place))

    def matches(self, words: list[bytes]) -> dict[str, tuple[float, int]]:
        """The largest containment of each label's templates in any block, and the first word of the first such block.

        Labels without a match are absent.
        """
        best: dict[str, tuple[float, int]] = {}
        all_words = set(words)
        for length, by_prefix in self.by_prefix.items():
            present = by_prefix.keys() & all_words
            if not present:
                continue
            stride = length // 2
            blocks = sorted({b for i, w in enumerate(words) if w in present for b in range(max(0, (i - length) // stride + 1), i // stride + 1)})
            for b in blocks:
                block = words[b * stride : b * stride + length]
                if len(block) <= stride and b:
                    continue  # wholly inside the block before
                own = set(block)
                candidates: dict[int, int] = {}
                for token in present & own:
                    for t, place in by_prefix[token]:
                        candidates[t] = min(place, candidates.get(t, place))
                for t, place in candidates.items():
                    tokens, label, need, naming = self.rows[t]
                    if len(own) < need or len(tokens) - place < need or not naming <= own:
                        continue
                    shared = sum(token in own for token in tokens[place:])
                    if shared >= need:
                        best[label] = max(best.get(label, (0.0, 0)), (shared / len(tokens), -b * stride))
        return {label: (share, -word) for label, (share, word) in best.items()}


def phrase_places(words: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively."""
    line, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        at = line.find(b" " + phrase + b" ")
        word, seen = 0, 0
        while at >= 0:
            word, seen = word + line.count(b" ", seen, at), at
            found.append((word, label))
            at = line.find(b" " + phrase + b" ", at + 1)
    return sorted(found)


def token_frequencies(documents: DataFrame, tokens: set[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many documents each of the given tokens stands; the tokens are those of the templates, so few."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for part in slices(batches, "text"):
            for raw in raw_texts(part, "text"):
                n.update(tokens.intersection(plain_words(raw)))
        yield pa.RecordBatch.from_pydict({"token": list(n.keys()), "n": list(n.values())}, schema=pa.schema([("token", pa.binary()), ("n", pa.int64())]))

    rows = documents.select(documents[text].alias("text")).mapInArrow(count, "token binary, n long")
    return {bytes(r[0]): r[1] for r in rows.groupBy("token").agg(F.sum("n")).collect()}


def scan_licences(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, tuple[str, str]] = TEMPLATES,
    threshold: float = 0.8,
) -> DataFrame:
    """doc_id, n_words, places (word, label), matches (label, containment, word): one row per document row.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered. A match has the largest containment of its
    label and the first word of the block it lies in. Templates may have any length. NULL and empty texts have no words, places or matches. Ids may be NULL or repeated; only the two named
    columns are read. Two passes over the texts (token frequencies, then the join), no shuffle of documents.
    """
    tokens = set().union(*(plain_words(t.encode()) for t in templates)) if templates else set()
    join = Templates(templates, threshold, token_frequencies(documents, tokens, text))
    known = {p.encode(): label for p, label in phrases.items()}
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    match = pa.list_(pa.struct([("label", pa.string()), ("containment", pa.float64()), ("word", pa.int64())]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, places, matches = [], [], []
            for raw in raw_texts(part, "text"):
                words = plain_words(raw)
                n.append(len(words))
                places.append([{"word": w, "label": x} for w, x in phrase_places(words, known)])
                matches.append([{"label": x, "containment": c, "word": w} for x, (c, w) in sorted(join.matches(words).items())])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, place), pa.array(matches, match)],
                names=["doc_id", "n_words", "places", "matches"],
            )

    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema[doc_id].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("places", T.ArrayType(T.StructType().add("word", T.LongType()).add("label", T.StringType()))),
            T.StructField("matches", T.ArrayType(T.StructType().add("label", T.StringType()).add("containment", T.DoubleType()).add("word", T.LongType()))),
        ]
    )
    return documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text")).mapInArrow(scan, schema)


def licence_digest(found: DataFrame) -> DataFrame:
    """Places and labels as flat columns; the score is 1 with a phrase, else the largest containment, else 0."""
    labels = lambda c: F.array_sort(F.array_distinct(c))
    base = F.transform("places", lambda p: p["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        F.array_join(labels(base), ",").alias("base_labels"),
        F.array_join(labels(F.concat(base, F.transform("matches", lambda m: m["label"]))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0)
        .otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)))
        .alias("score"),
    )


def licences_sql(phrases: dict[str, str] = PHRASES, templates: dict[str, tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> str:
    """The same rows in SQL: every block against every template."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    phrase_rows = ", ".join(f"({quoted(p)}, {quoted(label)}, {len(p.split())})" for p, label in phrases.items())
    template_rows = ", ".join(
        f"({i}, {quoted(label)}, {block_words(notice)}, {len(t)}, {quoted(w)}, {int(w in names)}, {len(names)})"
        for i, (notice, (label, naming)) in enumerate(templates.items())
        for t in [sorted({x.decode() for x in plain_words(notice.encode())})]
        for names in [{x.decode() for x in plain_words(naming.encode())}]
        for w in t
    )
    blocks = " UNION ALL ".join(
        f"SELECT rid, {length} AS length, p, unnest(list_distinct(w[p + 1 : p + {length}])) AS token FROM (SELECT rid, w, unnest(range(0, len(w), {length // 2})) AS p FROM d)"
        for length in sorted({block_words(notice) for notice in templates})
    )
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                   regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
                   FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
        phrases(phrase, label, n) AS (VALUES {phrase_rows}),
        templates(tid, label, length, m, token, naming, names) AS (VALUES {template_rows}),
        spots AS (SELECT rid, w, unnest(range(len(w))) AS i FROM d WHERE list_has_any(w, ['mit', 'apache', 'general'])),
        places AS (SELECT rid, i, label FROM spots JOIN phrases ON array_to_string(w[i + 1 : i + n], ' ') = phrase),
        b AS ({blocks}),
        matches AS (SELECT rid, label, count(*) / m AS containment FROM b JOIN templates USING (length, token)
                    GROUP BY rid, p, tid, label, m, names HAVING count(*) >= {threshold} * m - 1e-9 AND sum(naming) = names),
        base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY rid),
        labels AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
                   FROM (SELECT rid, label FROM places UNION ALL SELECT rid, label FROM matches) GROUP BY rid),
        top AS (SELECT rid, max(containment) AS containment FROM matches GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0)::DOUBLE END AS score
        FROM d LEFT JOIN base USING (rid) LEFT JOIN labels USING (rid) LEFT JOIN top USING (rid)"""
