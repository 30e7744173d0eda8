"""Homomorphic multiset hash of a document's paragraphs.

A paragraph is a line of the text.  It is hashed to a wide vector of two parts:

* identity, 4 lanes modulo 2**64: blake2b of the paragraph's bytes;
* likeness, 128 lanes modulo 2**32: for each pair of neighbouring words of the
  paragraph (its single word, if it has but one), a vector of +1 and -1 from the
  pair's hash.

A document's fingerprint is the sum of its paragraphs' vectors, lane by lane modulo
its power of two.  So the order of paragraphs doesn't matter, equal multisets have
equal fingerprints (and different ones differ but for a chance of some 2**-250), and
paragraphs are inserted and deleted by adding and subtracting their vectors, without
the rest of the text.  Sums of signs make distances mean something: the squared
norm of two fingerprints' difference, over the number of lanes, estimates the
squared differences of the pairs' counts, with a relative error of about
sqrt(2 / 128).  ``likeness`` is one minus this over both squared norms: 1 for equal
fingerprints, about the share of common pairs else.

Fingerprints are hex text of fixed length.  Texts are hashed in the task that reads
them; sums over groups of documents are pre-aggregated per task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_slices, stored
from tidemark.llm.words import CHUNK, STEP, Hasher, mixed

IDENTITY, LIKENESS = 4, 128
BYTES = IDENTITY * 8 + LIKENESS * 4
SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))  # of the two halves of a pair's signs
SPACE = b" \t\n\x0b\x0c\r"


class Sketcher:
    """Vectors of lists of paragraphs; keeps the tables of the word hash."""

    def __init__(self) -> None:
        self.hasher = Hasher()

    def pieces(self, data: bytes) -> Iterator[bytes]:
        """``data`` in runs of about ``CHUNK`` bytes that end at white space."""
        at = 0
        while at < len(data):
            end = at + CHUNK
            while end < len(data) and data[end] not in SPACE:
                end += 1
            yield data[at:end]
            at = end

    def pairs(self, data: bytes) -> Iterator[np.ndarray]:
        """Hashes of the pairs of neighbouring words of each line of ``data``, and of
        the words that are alone in theirs."""
        last_h, last_line, last_paired, past = np.zeros(0, np.uint64), np.zeros(0, np.int64), False, 0
        for part in self.pieces(data):
            raw = np.frombuffer(part, np.uint8)
            h, starts, _ = self.hasher(raw, np.zeros(1, np.int64))
            breaks = np.flatnonzero(raw == 10)
            line = np.concatenate([last_line, np.searchsorted(breaks, starts) + past])
            h = np.concatenate([last_h, h])
            past += len(breaks)
            if not len(h):
                continue
            same = line[1:] == line[:-1]
            yield mixed(h[:-1] * np.uint64(STEP) + h[1:])[same]
            paired = np.append(same, False) | np.insert(same, 0, last_paired)
            last_h, last_line, last_paired = h[-1:], line[-1:], bool(paired[-1])
            yield mixed(h[:-1][~paired[:-1]] ^ np.uint64(STEP))
        if not last_paired:
            yield mixed(last_h ^ np.uint64(STEP))

    def signs(self, found: np.ndarray) -> np.ndarray:
        """Sum of the vectors of +1 and -1."""
        out = np.zeros(LIKENESS, np.int64)
        for at in range(0, len(found), 4080):
            h = found[at : at + 4080]
            bits = np.empty((len(h), LIKENESS // 64), np.uint64)
            for j, seed in enumerate(SEEDS):
                bits[:, j] = mixed(h ^ seed)
            ones = np.unpackbits(bits.view(np.uint8), axis=1)
            for a in range(0, len(h), 255):  # sums of bytes that can't overflow
                out += 2 * ones[a : a + 255].sum(axis=0, dtype=np.uint8).astype(np.int64)
        return out - len(found)

    def vector(self, lines: str | None) -> np.ndarray:
        """Bytes of the sum over the lines of a text; None has no line, '' an empty one."""
        identity, likeness = np.zeros(IDENTITY, np.uint64), np.zeros(LIKENESS, np.int64)
        if lines is not None:
            data = lines.encode()
            for line in data.split(b"\n"):
                identity += np.frombuffer(hashlib.blake2b(line, digest_size=8 * IDENTITY).digest(), "<u8")
            for found in self.pairs(data):
                likeness += self.signs(found)
        return np.concatenate([identity.astype("<u8").view(np.uint8), likeness.astype("<u4").view(np.uint8)])

    def document(self, text: str | None) -> np.ndarray:
        """Fingerprint of a document; null and empty ones have no paragraphs."""
        return self.vector(text or None)

    def replaced(self, vector: np.ndarray, old: str, new: str, at: int) -> np.ndarray:
        """Fingerprint of ``new`` from that of ``old``, where both agree up to code point
        ``at``: the paragraphs from the one that holds it on are deleted, the others
        inserted.  Those before aren't read."""
        begin = old.rfind("\n", 0, at) + 1
        gone = self.vector(old[begin:] if old else None)
        come = self.vector(new[begin:] if new else None)
        return plus(minus(vector, gone), come)


def lanes(vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return vector[: IDENTITY * 8].view("<u8"), vector[IDENTITY * 8 :].view("<u4")


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([(x + y).view(np.uint8) for x, y in zip(lanes(a), lanes(b))])


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([(x - y).view(np.uint8) for x, y in zip(lanes(a), lanes(b))])


def from_hex(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), np.uint8)


def to_hex(vector: np.ndarray) -> str:
    return vector.tobytes().hex()


ZERO = "0" * (2 * BYTES)  # of the empty multiset


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two fingerprints, 0 to 1, from them alone."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (lanes(v)[1].view("<i4").astype(float) for v in (a, b))
    size = (x * x).sum() + (y * y).sum()
    return float(np.clip(1.0 - ((x - y) ** 2).sum() / size, 0.0, 1.0)) if size else 0.0


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text in ``out`` (replaced if there).
    Null and empty texts are the empty multiset, ``ZERO``.  No shuffle, no row dropped."""

    @F.pandas_udf("string")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sketcher = Sketcher()
        for batch in texts:
            yield batch.map(lambda t: to_hex(sketcher.document(t)))

    return docs.withColumn(out, of(F.col(text_col).cast("string")))


def combined(df: DataFrame, by: list[str], fingerprint_col: str = "fingerprint") -> DataFrame:
    """Fingerprint of all paragraphs of each group (of all rows, if ``by`` is empty): the
    sums of its rows' fingerprints.  Rows with a null fingerprint add nothing.

    Each task adds up its own rows by group first, lane by lane in the JVM's partial
    aggregation of (group, lane) sums."""

    @F.pandas_udf("array<decimal(20,0)>")
    def unpacked(col: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([x.astype(object) for x in lanes(from_hex(f))]).tolist() for f in col])

    rows = df.where(F.col(fingerprint_col).isNotNull()).select(*by, F.posexplode(unpacked(fingerprint_col)).alias("_lane", "_x"))
    sums = rows.groupBy(*by, "_lane").agg(F.sum(F.col("_x").cast("decimal(38,0)")).alias("_x"))
    wide = F.when(F.col("_lane") < IDENTITY, F.lit("18446744073709551616")).otherwise(F.lit("4294967296")).cast("decimal(38,0)")
    lane = sums.select(*by, F.struct("_lane", F.pmod("_x", wide).cast("string").alias("x")).alias("_e"))
    rolled = lane.groupBy(*by).agg(F.array_sort(F.collect_list("_e")).alias("_e")).withColumn("_x", F.col("_e.x"))

    @F.pandas_udf("string")
    def packed(col: pd.Series) -> pd.Series:
        return pd.Series([to_hex(np.concatenate([np.array([int(v) for v in x[:IDENTITY]], "<u8").view(np.uint8), np.array([int(v) for v in x[IDENTITY:]], "<u4").view(np.uint8)])) for x in col])

    return rolled.select(*by, packed("_x").alias(fingerprint_col))


def with_likeness(df: DataFrame, a: str, b: str, out: str = "likeness") -> DataFrame:
    """``df`` with the likeness of two fingerprint columns (null if one is)."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else likeness(from_hex(p), from_hex(q)) for p, q in zip(x, y)], dtype=float)

    return df.withColumn(out, of(a, b))


def ranges(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text) dealt to ``parts`` ranges of (doc_id, digest of the text), and
    the number of ranges that have rows: ``bucket, peek, doc_id, digest, text``.

    The last row of a range, ``peek``, is a copy of the first row of the next one (of the
    first range behind the last), so that each row meets its successor in its own
    task.  Null ids come first; rows of one id go by their digest; rows that repeat
    both are dealt to all ranges that their group spans, whatever its size."""
    spark = docs.sparkSession
    keyed = docs.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    keys = stored(keyed.select("doc_id", "digest"), "order-keys").withColumn("salt", F.monotonically_increasing_id())
    cuts = keys.repartitionByRange(parts, "doc_id", "digest", "salt").groupBy(F.spark_partition_id()).agg(F.min(F.struct("doc_id", "digest", "salt")).alias("k"))
    found = [(r["k"]["doc_id"] is not None, r["k"]["doc_id"] or 0, r["k"]["digest"], r["k"]["salt"]) for r in cuts.collect()]
    bounds = [k[:3] for k in sorted(found)]

    @F.pandas_udf("low int, high int")
    def place(ids: pd.Series, digests: pd.Series) -> pd.DataFrame:
        keys = [(i is not None, int(i or 0), d) for i, d in zip(ids, digests)]
        return pd.DataFrame({"low": [bisect_left(bounds, k) for k in keys], "high": [bisect_right(bounds, k) - 1 for k in keys]}).astype("int32")

    placed = keyed.withColumn("at", place(F.col("doc_id").cast("string"), "digest")).select("doc_id", "digest", "text", "at.low", "at.high")
    span = F.col("high") - F.col("low") + 1
    bucket = F.when(span > 0, F.col("low") + F.pmod(F.monotonically_increasing_id(), F.greatest(span, F.lit(1)))).otherwise(F.col("high"))
    rows = placed.select(bucket.cast("int").alias("bucket"), F.lit(False).alias("peek"), "doc_id", "digest", "text")
    firsts = placed.where("low <= high").groupBy("low", "high").agg(F.first("text").alias("text"))  # at most one row a bound
    firsts = firsts.select(F.explode(F.sequence("low", "high")).alias("bound"), "text")
    n = max(1, len(bounds))
    before = F.pmod(F.col("bound") - 1, F.lit(n)).cast("int")
    peeks = stored(firsts.select(before.alias("bucket"), F.lit(True).alias("peek"), F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("digest"), "text"), "order-peeks")
    return rows.unionByName(peeks), n


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_chars``, the digest of its edited text, the fingerprints
    of both, and the likeness of its own to the edited text's and to the next document's.

    The edited text has its last floor(n_chars / 4) code points replaced by the first
    as many (or all) of the next document by ascending id; after the last comes the
    first, which for a single document is itself.  Null ids come first; rows of one id
    go by the digest of their text.  A null text is an empty one.  Texts are shuffled
    once, by ranges of the id, and stream through their task with the next one in sight."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, n = ranges(given, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("peek", "doc_id", "digest")
    kinds = spark.createDataFrame([], EDITED).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, held = Sketcher(), None
        out: list[tuple] = []

        def report(doc_id, text, vector, after, theirs) -> tuple:
            k = len(text) // 4
            edited = text[: len(text) - k] + after[:k]
            changed = sketcher.replaced(vector, text, edited, len(text) - k) if k else vector
            digest = hashlib.sha256(edited.encode()).hexdigest()
            return doc_id, len(text), digest, to_hex(vector), to_hex(changed), likeness(vector, changed), likeness(vector, theirs)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=kinds.names)

        for batch in batches:
            for part in byte_slices(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    text = text or ""
                    vector = sketcher.document(text)
                    if held is not None:
                        out.append(report(*held, text, vector))
                    held = (doc_id, text, vector)
                if out:
                    yield batch_of(out)
                    out = []

    return dealt.select("doc_id", "text").mapInArrow(run, EDITED)


TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
