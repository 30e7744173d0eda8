"""Cases of the fourth round: stretches merged side by side, seeds in packed blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import prose


def test_stretches_merged_side_by_side():
    """The arrays of agendas give what one agenda after another gives, and what the library gives."""
    from tidemark.llm.queries import PIECE_MODEL, vocabulary
    from tidemark.llm.sentencepiece_codec import MARK, SHORT, Codec, Memory, stretches

    with open(vocabulary(PIECE_MODEL), "rb") as f:
        codec = Codec(f.read())
    rng = random.Random(8)
    signs = "abcxyzAÉéßÿÀÞ×÷0123'.,*#<|>&%$-_~ \n\t\x00 ̈́ﬁΣσİ漢😀aaaaaee"
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [prose(i, 300) for i in range(20)]
    made += ["a" * SHORT, "a" * (SHORT - 1), "a" * (SHORT + 1), "   ", "x ", " x  y", "\n", "😀" * 20, MARK + "x"]
    cut = {s for t in made for s in stretches(t)}
    short = sorted(s for s in cut if len(s) <= SHORT)
    assert codec.merged_many(short) == {s: tuple(codec.merged(s)) for s in short}
    memory = Memory(codec)
    memory.learn(cut)
    assert set(memory) == set(short) - {MARK}
    for t in made:
        assert [i for s in stretches(t) for i in memory[s]] == codec.library.encode(t)
    memory.check()
    for planted in (f"{MARK}planted", MARK * 3):  # among others, and alone
        memory.learn({f"{MARK}other{i}" for i in range(100)} | {planted})
        memory[planted] = (5, 6)
        memory.fresh.append(planted)
        with pytest.raises(ValueError, match=planted):
            memory.check()
        memory.fresh.clear()


def one_by_one(a, b, least):
    """Chains by scoring all that is left again after each."""
    from tidemark.llm import chain_dedup

    while len(a) > 1:
        chain = chain_dedup.best_chain(a, b)
        x, y = a[chain], b[chain]
        if min(x[-1] - x[0], y[-1] - y[0]) + chain_dedup.SEED >= least:
            yield x.tolist(), y.tolist()
        rest = np.ones(len(a), bool)
        rest[chain] = False
        rest &= ~((a >= x[0]) & (a <= x[-1]) & (b >= y[0]) & (b <= y[-1]))
        a, b = a[rest], b[rest]


def test_chains_in_parts_equal_one_by_one():
    """Stray matches and repeated lines; a pair of 6,000 stray matches isn't scored once for each."""
    from tidemark.llm import chain_dedup

    rng = np.random.default_rng(11)
    for k in range(150):
        lines = rng.integers(0, 3000, rng.integers(0, 6)), rng.integers(0, 3000, rng.integers(0, 6))
        line = np.arange(rng.integers(3, 20))
        found = [(x + i, y + i) for x in lines[0] for y in lines[1] for i in line] + [tuple(p) for p in rng.integers(0, 3000, (rng.integers(1, 80), 2))]
        rows = np.array(sorted({(int(y), int(x)) for x, y in found}))
        a, b = rows[:, 1].copy(), rows[:, 0].copy()
        got = sorted((x.tolist(), y.tolist()) for x, y in chain_dedup.chains_of(a, b, 18))
        assert got == sorted(one_by_one(a, b, 18)), k
    calls = []
    scores = chain_dedup.scores
    a = np.arange(6000)[::-1] * 40
    with pytest.MonkeyPatch.context() as m:
        m.setattr(chain_dedup, "scores", lambda a, b: calls.append(len(a)) or scores(a, b))
        assert not list(chain_dedup.chains_of(a, np.arange(6000) * 40, 18))
    assert len(calls) <= 2


def test_seeds_and_blocks(frame, spark):
    """Seeds of whole runs of texts, and blocks that hold every seed in few bytes."""
    from tidemark.llm import chain_dedup
    from tidemark.llm.suffix_dedup import minimisers
    from tidemark.llm.words import word_chunks

    texts = [None, "", "a", "a b c", "a b c d", "a b c d e", "x x x x x x x", *(prose(i, 5 + 7 * i) for i in range(40)), "a b"]
    for _, _, h, at, *_ in word_chunks(pa.array(texts)):
        want = [p + lo for lo, hi in zip(at[:-1], at[1:]) for p in minimisers(h[lo:hi], chain_dedup.SEED, 2)[0]]
        assert chain_dedup.least_in_windows(h, at).tolist() == want
    rng = np.random.default_rng(2)
    cols = [rng.integers(-(2**62), 2**62, 50), rng.integers(0, 9, 50), rng.integers(-5, 5, 50)]
    assert chain_dedup.unpacked(chain_dedup.packed(cols), 50, 3).tolist() == [c.tolist() for c in cols]
    docs = frame([(i, prose(i, 800)) for i in range(200)] + [(None, "a b c d e f")])
    blocks = chain_dedup.seed_blocks(docs.coalesce(1), "doc_id", "text", 2).collect()
    n = sum(r["n"] for r in blocks)
    assert len(blocks) == 2 * chain_dedup.BLOCKS and 200 * 797 / 2 <= n <= 200 * 797
    assert all(r["part"] == r["block"] % 2 for r in blocks) and sum(len(r["rows"]) for r in blocks) < 12 * n
