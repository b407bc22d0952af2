"""Secret scans over an incremental ledger of blobs.

Every version of a file is addressed by the SHA-256 of its content. The ledger is a table of (blob, rule version,
spans); a scan reads each blob that the ledger lacks for the present rule version once, however many versions and
paths carry it, appends the result (also an empty one) and joins the ledger back to all versions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.text import slices, texts

RULE_VERSION = "2"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----)?")
#: ASCII lower-casing that keeps the length, for the word test before the expression is run.
_LOWER = {c: c + 32 for c in range(65, 91)}
_HEX_MARKS = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))

SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start and then kind as listed in ``KINDS``."""
    found = []
    low = text.translate(_LOWER) if not text.isascii() else text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in text.encode().translate(_HEX_MARKS):
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        found += [("jwt", m.start(), m.end()) for m in _JWT.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [("pem", m.start(), m.end()) for m in _PEM.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def address(text: Column) -> Column:
    """The blob address of a content; NULL content is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for part in slices(batches, "content"):
        spans = [[dict(zip(("kind", "start", "end"), s)) for s in secret_spans(t)] for t in texts(part, "content")]
        yield pa.RecordBatch.from_arrays([part.column("blob"), pa.array(spans, kinds)], names=["blob", "spans"])


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger stored at ``path``; an empty one is begun where there is none."""
    schema = T.StructType(
        [T.StructField("blob", T.StringType()), T.StructField("rule_version", T.StringType()), T.StructField("spans", SPANS)]
    )
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def scan_new_blobs(versions: DataFrame, ledger_path: str, content: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Scans the blobs that the ledger lacks for this rule version, appends them, and returns the ledger.

    Versions with equal content are one blob. NULL content is the empty blob. A run that is repeated scans nothing.
    """
    spark = versions.sparkSession
    known = open_ledger(spark, ledger_path).filter(F.col("rule_version") == rule_version).select("blob")
    blobs = versions.select(address(versions[content]).alias("blob"), F.coalesce(versions[content], F.lit("")).alias("content"))
    unseen = blobs.join(known, "blob", "left_anti").dropDuplicates(["blob"])
    new = unseen.mapInArrow(_scan, T.StructType([T.StructField("blob", T.StringType()), T.StructField("spans", SPANS)]))
    new.select("blob", F.lit(rule_version).alias("rule_version"), "spans").write.mode("append").parquet(ledger_path)
    return open_ledger(spark, ledger_path)


def scan_history(
    versions: DataFrame, ledger_path: str, path: str = "doc_id", content: str = "text", rule_version: str = RULE_VERSION
) -> DataFrame:
    """doc_id, blob, spans of every version: one row per row, spans empty where nothing was found.

    Ids may be NULL or repeated; only the two named columns are read; an empty table gives an empty result.
    """
    ledger = scan_new_blobs(versions, ledger_path, content, rule_version).filter(F.col("rule_version") == rule_version)
    return versions.select(versions[path].alias("doc_id"), address(versions[content]).alias("blob")).join(
        ledger.select("blob", "spans"), "blob"
    ).select("doc_id", "blob", "spans")


def joined_spans(spans: Column, base: bool = False) -> Column:
    """kind:start:end of the spans in their order, comma-joined; only the base kinds, if asked."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS)) if base else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined_spans(F.col("spans"), base=True), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def _mask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        out = []
        for text, spans in zip(part.column("text").to_pylist(), part.column("_spans").to_pylist()):
            if spans:
                pieces, at = [], 0
                for s in spans:
                    if s["end"] > at:
                        pieces += [text[at : s["start"]], "[secret]"] if s["start"] >= at else []
                        at = s["end"]
                text = "".join([*pieces, text[at:]])
            out.append(text)
        names = [n for n in part.schema.names if n != "_spans"]
        columns = [pa.array(out, pa.string()) if n == "text" else part.column(n) for n in names]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def mask_secrets(documents: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """All documents, every found secret replaced by ``[secret]``, ``n_chars`` counted anew where there is one."""
    ledger = scan_new_blobs(documents, ledger_path, "text", rule_version)
    flagged = ledger.filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0))
    flagged = flagged.select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    joined = documents.join(flagged, address(documents["text"]) == flagged["_blob"], "left").drop("_blob")
    masked = joined.mapInArrow(_mask, documents.schema)
    if "n_chars" not in documents.columns:
        return masked
    kind = documents.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
