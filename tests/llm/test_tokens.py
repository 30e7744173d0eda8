"""SentencePiece codec and token shards against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import ODD, prose
from tidemark.llm import token_output
from tidemark.llm.queries import PIECE_MODEL, WORD_MODEL, vocabulary
from tidemark.llm.sentencepiece_codec import MARK, Codec, Memory, encode_decode, id_array, stretches


def hard_texts():
    rng = random.Random(4)
    texts = [t for t in ODD if t is not None] + ["x" * 3000, "  a   b  ", MARK, " " + MARK, "\r\n a;\r b", "<0x0A><unk></s>", prose(1, 30_000)]
    return texts + ["".join(rng.choice(f" {MARK}\n\r;{{}}()ab<s>é😀́theing") for _ in range(60)) for _ in range(300)]


def test_codec_equals_the_library():
    with open(vocabulary(PIECE_MODEL), "rb") as f:
        codec = Codec(f.read())
    memory = Memory(codec)
    for text in hard_texts():
        ids = [i for s in stretches(text) for i in memory[s]]
        assert ids == codec.library.encode(text), text[:80]
    memory.check()
    for text in ("abab" * 20, "therethere" * 9):  # the heap and the list agree
        assert codec.merged_long(text) == codec.merged_short(text)
    memory[f"{MARK}planted"] = (5, 6)
    memory.fresh.append(f"{MARK}planted")
    with pytest.raises(ValueError):
        memory.check()


def test_encode_decode_rows(frame):
    rows = list(enumerate([*ODD, "a b", "a b", prose(2, 500)]))
    df = frame(rows).withColumn("ids", F.lit("clash")).withColumn("lang", F.lit("en"))
    out = encode_decode(df, vocabulary(PIECE_MODEL))
    assert out.columns == ["doc_id", "lang", "ids", "n_tokens", "decoded"]
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_MODEL))
    for r in out.withColumn("array", id_array(F.col("ids"))).collect():
        want = library.encode(dict(rows)[r["doc_id"]] or "", add_eos=True)
        assert r["array"] == want and r["n_tokens"] == len(want) and r["decoded"] == library.decode(want)
    bare = encode_decode(frame([(1, None)]), vocabulary(PIECE_MODEL), add_end=False)
    assert bare.withColumn("array", id_array(F.col("ids"))).first()["array"] == []
    assert encode_decode(frame([]), vocabulary(PIECE_MODEL)).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 1000, 20_000):
        ids = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        shift = token_output.build_hash(ids)
        assert sorted(token_output.slots_of(ids, shift, len(ids))) == list(range(len(ids)))


def test_token_shards_round_trip(spark, frame):
    from tokenizers import Tokenizer

    texts = [*ODD, "Ünïcode ΟΔΟΣ Σ", "it's <|endoftext|> we'll x y", prose(3, 5000), "tie", "tie"]
    rows = [(10 * (i % 7) + i - 20, t) for i, t in enumerate(texts)] + [(500, "one"), (500, "two two"), (None, "no id")]
    df = frame(rows)
    shards = token_output.write_shards(df, vocabulary(WORD_MODEL), end_id=1)
    index, parts = token_output.build_index(spark, shards)
    found = token_output.lookup(df.select("doc_id").distinct(), index, parts)
    payload = token_output.read_documents(found, shards)
    got = token_output.document_checksums(payload, token_output.directory(spark, shards)).collect()
    library = Tokenizer.from_file(vocabulary(WORD_MODEL))
    want = sorted((-(10**9) if i is None else i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows)
    said = sorted((-(10**9) if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got)
    assert said == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i))
    strange = token_output.lookup(frame([(i, "") for i in range(10_000, 11_000)]), index, parts)
    assert strange.count() == 0


def test_token_shards_of_an_empty_table(spark, frame):
    shards = token_output.write_shards(frame([]), vocabulary(WORD_MODEL), end_id=1)
    index, parts = token_output.build_index(spark, shards)
    found = token_output.lookup(frame([(1, "x")]), index, parts)
    assert token_output.document_checksums(token_output.read_documents(found, shards), token_output.directory(spark, shards)).count() == 0


def test_queries_equal_the_libraries(spark, small):
    from tokenizers import Tokenizer

    from tidemark.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_MODEL))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in QUERIES["op6_sentencepiece"](spark, small).collect():
        ids = library.encode(docs[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    words, at = Tokenizer.from_file(vocabulary(WORD_MODEL)), 0
    got = {r["doc_id"]: r for r in QUERIES["op8_token_output"](spark, small).collect()}
    for i in sorted(docs):
        ids = words.encode(docs[i], add_special_tokens=False).ids + [1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)
