"""Cases of the fifth round: memory of the workers between operators, words that end in signs."""

import corpus_pipeline
import numpy as np

from tidemark.llm import token_output
from tidemark.llm.common import worker_cache
from tidemark.llm.queries import WORD_MODEL, vocabulary


def test_quality_sends_texts_once(spark, small, monkeypatch):
    """The pipeline's classifier gets each text in one column, and gives back the same rows."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kind, seen = type(docs), []
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: seen.append(self) or plain(self, *a, **k))
    good = corpus_pipeline.quality(spark, docs, small)
    row = seen[-1].limit(1).collect()[0]
    text = docs.select("text").limit(1).collect()[0][0]
    assert list(row).count(text) == 1
    assert good.schema.names == docs.columns and good.exceptAll(docs).count() == 0 < good.count()


def test_a_worker_keeps_one_object(monkeypatch):
    monkeypatch.delattr("sys._tidemark_worker_cache", raising=False)
    first = worker_cache("first", lambda: [1])
    assert worker_cache("first", lambda: [2]) is first
    assert worker_cache("second", lambda: [3]) == [3]
    assert worker_cache("first", lambda: [4]) == [4]


class Counted:
    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, piece):
        self.asked.append(piece)
        return self.model.tokenize(piece)


def test_words_before_signs_are_not_asked_again():
    with open(vocabulary(WORD_MODEL), encoding="utf-8") as f:
        words = token_output.Vocabulary(f.read(), 2)
    words.model = model = Counted(words.model)
    ids = lambda t: words.library.encode(t, add_special_tokens=False).ids
    told = lambda t: np.frombuffer(words.encode([t.encode()])[0], "<u2").tolist()
    for t in ("enunheit ciónado Éreque", "enunheit. ciónado!! Éreque***", "(enunheit) enunheit.ciónado"):
        assert told(t) == ids(t)
    assert [model.asked.count(p) for p in ("enunheit", model.asked[1], model.asked[2])] == [1, 1, 1]
    for t in ("a'. it's. x<. |. <|endoftext|>. '.! ... é'!! 7. a1.b2, ̈́. ×. a×. ß! \x00.", "<|endoftext|>A.B É."):
        assert told(t) == ids(t)
