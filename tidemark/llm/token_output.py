"""Token ids as raw binary shards with a minimal perfect hash index.

Shards.  Documents are dealt by ranges of their id and sorted within, so shards
and the documents in them ascend.  A shard file holds the ids of its documents as
unsigned little-endian 16-bit integers (32-bit for vocabularies above 65,536),
each document closed by the end id; then a directory (ids of documents and
number of tokens, as 64-bit integers), its number of entries as a 64-bit
integer, the width in bytes as another, and the end id once more.  The files are
written by Spark's text sink with the end id as the line separator: bytes go
through as they are, and a lost or repeated task commits one file or none.

Index.  Keys are dealt by a hash into parts of about ``PART_KEYS``.  Each part has a
minimal perfect hash: keys fall into buckets of about 4, and for each bucket, the
largest first, a displacement is searched that sends its keys to free slots.  A
slot stores a fingerprint of its key, the shard, the first token, the number of
documents of that key and their tokens.  A lookup is two hashes, one displacement and one
slot: constant time; a strange key is refused by its 32-bit fingerprint.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import broadcast_if_small, byte_slices, stored, worker_cache
from tidemark.llm.words import mixed
from tidemark.session import scratch_path

PART_KEYS = 50_000
NULL_KEY = -(1 << 63)
GENERATION = 40 << 20  # bytes of words and their ids, estimated; a worker keeps two generations


def byte_letters() -> list[str]:
    """Character that a byte-level tokenizer writes for each byte: itself if it prints
    in Latin-1, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """The tokenizers library, asked for each word that it was not asked lately.

    Words of Latin-1 letters, digits and ASCII signs fall into the runs that the
    pre-tokenizer makes of them and go straight to the library's model; all others go
    through the whole library.  Two generations of ``GENERATION`` bytes are kept."""

    SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<>|")
    RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=?-@\[-`{}~]+")
    PLAIN = re.compile(r"(?:[a-zA-Zß-öø-ÿÀ-ÖØ-Þ0-9!-&(-/:;=?-@\[-`{}~])+")

    def __init__(self, text: str, width: int) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.model = self.library.model
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        self.letters = byte_letters()
        self.raw = [i.to_bytes(width, "little") for i in range(self.library.get_vocab_size())]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0
        self.short: dict[str, bytes] = {}
        self.tails: dict[bytes, bytes] = {}

    def run(self, piece: str) -> bytes:
        """Ids of one run, which the pre-tokenizer doesn't part."""
        if not piece.isascii():
            piece = piece.encode().decode("latin1").translate(self.letters)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(piece)])

    def parts(self, word: str) -> bytes:
        """Ids of a plain word in lower case, run by run; short runs, of which there are
        few, are kept, and long ones may have been met as words."""
        short, young, out = self.short, self.young, []
        runs = self.RUNS.findall(word)
        if len(runs) == 1:
            return self.run(word)
        for r in runs:
            found = short.get(r)
            if found is None and len(r) > 2:
                found = young.get(r.encode())
            if found is None:
                found = self.run(r)
                if len(r) < 3:
                    short[r] = found
            out.append(found)
        return b"".join(out)

    def learn(self, new: set[bytes]) -> None:
        """Takes in words that the young generation doesn't hold, plain letters first."""
        young, old, ask, signs = self.young, self.old, [], []
        ids, tokenize, plain = self.raw, self.model.tokenize, self.PLAIN.fullmatch
        for w in new:
            raw = old.get(w)
            if raw is None:
                if not (w.isalpha() and w.islower()):
                    signs.append(w)
                    continue
                raw = b"".join([ids[t.id] for t in tokenize(w.decode())])  # one run of ASCII letters
            young[w] = raw
        tails = self.tails
        for w in signs:
            base = w.rstrip(self.SIGNS)
            if plain(word := base.decode()) is not None:  # it ends in a letter or digit, which parts it from the signs
                raw = young.get(base) or old.get(base) or self.parts(word.lower())
                if len(base) < len(w):
                    tail = w[len(base) :]
                    end = tails.get(tail)
                    if end is None:
                        end = self.run(tail.decode())
                        if len(tail) < 4:
                            tails[tail] = end
                    raw += end
                young[w] = raw
            elif not base:
                young[w] = self.run(w.decode())
            else:  # also what may hold a special token
                ask.append(w)
        for at in range(0, len(ask), 1000):
            part = ask[at : at + 1000]
            for w, found in zip(part, self.library.encode_batch([w.decode() for w in part], add_special_tokens=False)):
                young[w] = np.array(found.ids, self.kind).tobytes()
        self.size += 200 * len(new) + sum(map(len, new)) + sum(map(len, map(young.__getitem__, new)))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Raw ids of each text.  No token of the supported tokenizers spans ASCII white
        space, nor a letter and a sign, and letters are lowered: a text is the
        sequence of its words' ids, in lower case unless it may name a special token."""
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        found = [list(map(self.young.get, ws)) for ws in words]
        gaps = [[i for i, raw in enumerate(f) if raw is None] if None in f else [] for f in found]
        self.learn({ws[i] for ws, g in zip(words, gaps) for i in g})
        for ws, f, g in zip(words, found, gaps):
            for i in g:
                f[i] = self.young[ws[i]]
        out = [b"".join(f) for f in found]
        if self.size > GENERATION:
            self.old, self.young, self.size = self.young, {}, 0
        return out


# Fixed value: the pattern of the supported pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_words(tokenizer: str) -> bool:
    """Whether the tokenizer lowers letters, drops white space and parts letters from
    signs before its model runs, and so gives each such run the same ids wherever it
    stands."""
    found = json.loads(tokenizer)
    steps = found.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    lowers = "Lowercase" in [n.get("type") for n in (found.get("normalizer") or {}).get("normalizers", [])]
    return lowers and first.get("pattern", {}).get("Regex") == PATTERN and first.get("behavior") == "Removed" and bool(first.get("invert"))


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> str:
    """Writes the shards to the shared scratch folder and returns their path.

    Null texts are empty: only the end id.  Null ids come first, under a key of
    their own.  Rows of equal id are all written, next to each other."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    if not splits_words(tokenizer):
        raise ValueError("not a tokenizer of the supported kind: words can't be encoded one by one")
    width = 2 if max(json.loads(tokenizer)["model"]["vocab"].values()) < 1 << 16 and end_id < 1 << 16 else 4
    end = end_id.to_bytes(width, "little")
    if not end.isascii():
        raise ValueError("the line separator of the text sink must be ASCII: no byte of the end id above 127")
    key = f"vocabulary-{zlib.crc32(tokenizer.encode())}-{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        vocabulary = worker_cache(key, lambda: Vocabulary(tokenizer, width))
        ids, counts = [], []
        for batch in batches:
            for part in byte_slices(batch, 1 << 20, 256):
                raw = vocabulary.encode([x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()])
                ids.append(part.column(0).to_numpy())
                counts.append(np.array([len(x) // width + 1 for x in raw], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["raw"])
        if ids:
            n = sum(map(len, ids))
            directory = np.concatenate([*ids, *counts, [n, width]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([directory], pa.binary())], ["raw"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).alias("id"), F.col(text_col).cast("string").alias("text"))
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "id").sortWithinPartitions("id")
    path = scratch_path(spark, "token-shards")
    dealt.mapInArrow(run, "raw binary").select(F.col("raw").cast("string")).write.option("lineSep", end.decode("latin1")).text(path)
    return path


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``file, shard, length`` of the shard files; no content is read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length"))
    return files.withColumn("shard", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))


def opened(file: str):
    system, path = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
    return system.open_input_file(path)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """``id, shard, file, width, first, n_tokens`` of every document, from the ends of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, shard, length in zip(*[c.to_pylist() for c in batch.columns]):
                with opened(file) as f:
                    for width in (2, 4):
                        n, said = np.frombuffer(f.read_at(16, length - width - 16), "<i8")
                        if said == width:
                            break
                    table = np.frombuffer(f.read_at(16 * n, length - width - 16 - 16 * n), "<i8")
                ids, counts = table[:n], table[n:]
                yield pa.RecordBatch.from_pydict(
                    {"id": ids, "shard": np.full(n, shard, np.int32), "width": np.full(n, width, np.int32), "first": np.cumsum(counts) - counts, "n_tokens": counts}
                )

    files = listing(spark, path).select("file", "shard", "length")
    spread = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard")
    return spread.mapInArrow(run, "id long, shard int, width int, first long, n_tokens long")


def key_hash(ids: np.ndarray, seed) -> np.ndarray:
    return mixed(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(seed, np.uint64) * np.uint64(0xD1342543DE82EF95))


def build_hash(ids: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash over distinct ``ids``."""
    n = len(ids)
    buckets = max(1, -(-n // 4))
    owner = (key_hash(ids, 1) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    limits = np.searchsorted(owner[order], np.arange(buckets + 1))
    size = np.diff(limits)
    taken = np.zeros(n, bool)
    shift = np.zeros(buckets, np.int64)
    tries = np.arange(2, 66, dtype=np.uint64)
    for b in np.argsort(-size, kind="stable"):
        if size[b] == 0:
            break
        mine = ids[order[limits[b] : limits[b + 1]]]
        seed = 0
        while True:
            slots = (key_hash(mine[None, :], (tries + np.uint64(seed))[:, None]) % np.uint64(n)).astype(np.int64)
            free = ~taken[slots].any(axis=1)
            if size[b] > 1:
                ranked = np.sort(slots, axis=1)
                free &= (np.diff(ranked, axis=1) != 0).all(axis=1)
            hit = np.flatnonzero(free)
            if len(hit):
                taken[slots[hit[0]]] = True
                shift[b] = seed + hit[0] + 2
                break
            seed += len(tries)
    return shift


def slots_of(ids: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    bucket = (key_hash(ids, 1) % np.uint64(len(shift))).astype(np.int64)
    return (key_hash(ids, shift[bucket].astype(np.uint64)) % np.uint64(n)).astype(np.int64)


SLOT = np.dtype([("mark", "<u4"), ("shard", "<i4"), ("width", "<i4"), ("docs", "<i4"), ("first", "<i8"), ("tokens", "<i8")])


def parts_for(keys: int) -> int:
    return max(1, -(-keys // PART_KEYS))


def build_index(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Index of the shards under ``path``: ``part, n, shift, slots`` (bytes), stored,
    and the number of parts.  One row a part; a part's keys fit in one task."""
    entries = directory(spark, path)
    keys = stored(
        entries.groupBy("id").agg(
            F.min("shard").alias("shard"), F.min("width").alias("width"), F.count("*").cast("int").alias("docs"),
            F.min("first").alias("first"), F.sum("n_tokens").alias("tokens"),
        ), "token-keys",
    )
    parts = parts_for(keys.count())

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        shift = build_hash(ids)
        slots = np.zeros(len(ids), SLOT)
        at = slots_of(ids, shift, len(ids))
        slots["mark"][at] = (key_hash(ids, 0) >> np.uint64(32)).astype(np.uint32)
        for c in ("shard", "width", "docs", "first", "tokens"):
            slots[c][at] = pdf[c].to_numpy()
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "n": [len(ids)], "shift": [shift.astype("<i8").tobytes()], "slots": [slots.tobytes()]})

    dealt = keys.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    return stored(dealt.groupBy("part").applyInPandas(build, "part long, n long, shift binary, slots binary"), "token-index"), parts


def lookup(keys: DataFrame, index: DataFrame, parts: int, id_col: str = "doc_id") -> DataFrame:
    """``id, shard, width, docs, first, tokens`` of every row of ``keys`` that is in the
    index.  A part is looked up in groups of rows, of which each holds the part once."""
    rows = keys.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).alias("id"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))

    def find(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", *SLOT.names[1:])})
        if not len(asked) or not len(held):
            return empty
        ids = asked["id"].to_numpy()
        shift, slots = np.frombuffer(held["shift"].iloc[0], "<i8"), np.frombuffer(held["slots"].iloc[0], SLOT)
        got = slots[slots_of(ids, shift, len(slots))]
        sure = got["mark"] == (key_hash(ids, 0) >> np.uint64(32)).astype(np.uint32)
        return pd.DataFrame({"id": ids[sure]} | {c: got[c][sure] for c in SLOT.names[1:]})

    return rows.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(find, "id long, shard int, width int, docs int, first long, tokens long")


def read_documents(found: DataFrame, path: str) -> DataFrame:
    """``id, shard, offset, n_tokens, raw`` (little-endian ids, the end id last): the
    payload of every row of ``found``, read at its place in its shard.

    Documents of one key lie together; they are told apart by the directory."""
    spark = found.sparkSession
    files = broadcast_if_small(stored(listing(spark, path).select("shard", "file", "length"), "token-files"))
    rows = found.join(files, "shard").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "first")

    longs = {"id": pa.int64(), "shard": pa.int32(), "offset": pa.int64(), "n_tokens": pa.int64(), "width": pa.int32()}
    kinds = pa.schema([*longs.items(), ("raw", pa.binary())])

    def counts_of(f, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and token counts of a shard's documents."""
        n = int(np.frombuffer(f.read_at(8, length - width - 16), "<i8")[0])
        table = np.frombuffer(f.read_at(16 * n, length - width - 16 - 16 * n), "<i8")
        return table[:n], table[n:]

    def payload(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """One document at a time.  The directory of a shard is read once, and only if a
        repeated key asks for it."""
        name, f, listed = None, None, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("id", "shard", "width", "docs", "first", "tokens", "file", "length")]
            for key, shard, width, docs, first, tokens, file, length in zip(*cols):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f, listed = file, opened(file), None
                counts = [tokens]
                if docs > 1:
                    listed = listed or counts_of(f, length, width)
                    place = int(np.searchsorted(listed[0], key))
                    counts = listed[1][place : place + docs].tolist()
                for c in counts:
                    yield key, shard, first, c, width, f.read_at(c * width, first * width)
                    first += c
        if f is not None:
            f.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in payload(batches):
            out.append(row)
            size += len(row[-1])
            if size > 1 << 20 or len(out) == 2048:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)], names=kinds.names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)], names=kinds.names)

    return rows.mapInArrow(run, "id long, shard int, offset long, n_tokens long, width int, raw binary")


def document_checksums(payload: DataFrame, entries: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: place among all ids, and the crc32 of the
    ids as unsigned 32-bit integers, computed in the tasks that hold the payload."""
    totals = entries.groupBy("shard").agg(F.sum("n_tokens").alias("all"))
    base = totals.select("shard", (F.sum("all").over(Window.orderBy("shard")) - F.col("all")).alias("base"))

    @F.pandas_udf("long")
    def crc(raw: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(r, f"<u{w}").astype("<u4").tobytes()) for r, w in zip(raw, width)])

    small = payload.select("id", "shard", "offset", "n_tokens", crc("raw", "width").alias("ids_crc32"))
    joined = small.join(broadcast_if_small(stored(base, "token-bases")), "shard")
    doc_id = F.when(F.col("id") != NULL_KEY, F.col("id"))
    return joined.select(doc_id.alias("doc_id"), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
