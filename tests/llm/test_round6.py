"""Cases of the sixth round: texts merged as columns, one object for each id."""

import random

import corpus_pipeline
import numpy as np
import pytest

from tidemark.llm import sentencepiece_codec
from tidemark.llm.common import BATCH_BYTES
from tidemark.llm.queries import PIECE_MODEL, vocabulary
from tidemark.llm.sentencepiece_codec import MARK, Codec, Memory, stretches


@pytest.fixture(scope="module")
def codec():
    with open(vocabulary(PIECE_MODEL), "rb") as f:
        return Codec(f.read())


def test_ids_and_their_text_equal_the_library(codec):
    rng = random.Random(5)
    signs = "abcxyzAÉéßÿ×÷0123'.,*#<|>&%$-_~ \n\t\x00\x7f ̈́ﬁΣσİ漢😀aaaaaee" + MARK
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    made += ["\n", " \n", "\n ", "a\n\nb", "a \n b", f"{MARK}\n", "\n" * 70]
    assert codec.lines
    memory = Memory(codec)
    cut = [stretches(t, codec.lines) for t in made]
    assert all("\n" not in s[1:] for c in cut for s in c)
    memory.learn({s for c in cut for s in c})
    ids = [[i for s in c for i in memory[s]] for c in cut]
    assert ids == codec.library.encode(made)
    assert codec.told_of(ids, np.array(list(map(len, ids)))).to_pylist() == [" ".join(map(str, x)) for x in ids]
    memory.check()


def test_an_id_is_one_object(codec):
    """However many stretches of the memory hold it."""
    memory = Memory(codec)
    memory.learn({f"{MARK}enunheit{a}{b}" for a in "abcdefgh" for b in "ijklmnop"} | {f"{MARK}漢{c}" for c in "abcdefgh"})
    memory[MARK + "long" * sentencepiece_codec.SHORT]
    told = [i for ids in memory.values() for i in ids]
    assert len({id(i) for i in told}) == len(set(told)) < len(told)


def test_a_wrong_line_is_told(codec):
    memory = Memory(codec)
    memory.learn({f"{MARK}one", "\ntwo", "\nthree"})
    memory.check()
    memory["\ntwo"] = (5, 6)
    memory.fresh += ["\nthree", "\ntwo"]
    with pytest.raises(ValueError, match=r"'\\ntwo'"):
        memory.check()


def test_the_pipeline_sends_small_batches(spark, frame):
    """A table that went to a worker whole, as one batch, goes in several; rows are the same."""
    docs = frame([(i, f"word{i} " * 2000) for i in range(600)]).coalesce(1)
    before = spark.conf.get(BATCH_BYTES)
    try:
        spark.conf.unset(BATCH_BYTES)
        coded = corpus_pipeline.pieces(spark, docs, "")
        assert coded.count() == 600 and coded.where("n_tokens < 2000").count() == 0
        assert batches(docs) > 1
        spark.conf.set(BATCH_BYTES, "32m")
        corpus_pipeline.pieces(spark, docs, "")
        assert spark.conf.get(BATCH_BYTES) == "32m" and batches(docs) == 1
    finally:
        spark.conf.set(BATCH_BYTES, before)


def batches(docs):
    import pyarrow as pa

    def count(given):
        yield pa.RecordBatch.from_pydict({"n": [sum(1 for _ in given)]})

    return docs.mapInArrow(count, "n long").groupBy().sum("n").first()[0]
