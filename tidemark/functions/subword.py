"""Subword tokens by greedy longest match over a vocabulary given as a table.

A word is matched from its start with the longest piece of the vocabulary, then from
there on with the longest continuation piece (marked by a prefix), and so on; a word
with a rest that no piece begins is one unknown token.  The pieces are two tries in
one, the second for continuations.  Every node has a failure link: the node that
stands for the rest of its string once the greedy pieces of that string are taken off,
and how many these are.  A word is thereby read once from left to right, without going
back, however the pieces overlap.

Texts are parted into words by expressions in the JVM; distinct words of an Arrow
batch are matched once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip_accents

MAX_PIECES = 1_000_000  # the vocabulary travels to the tasks
MAX_WORD = 100  # a longer word is one unknown token
CONTINUED = "##"
# a sign or an ideograph each, or a run of other characters that are no white space
SIGN = r"\p{P}$+<=>^`|~"
IDEOGRAPH = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2FA1F}\x{F900}-\x{FAFF}"
WORD = rf"[{SIGN}{IDEOGRAPH}]|[^\s\p{{Z}}{SIGN}{IDEOGRAPH}]+"
NONE, START, REST = -1, 0, 1  # no node, the roots of the two tries


class PieceTrie:
    """Trie of pieces with failure links; counts the pieces of a word."""

    def __init__(self, pieces: Iterable[str], continued: str = CONTINUED) -> None:
        self.children: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for piece in pieces:
            rest = bool(continued) and piece.startswith(continued) and len(piece) > len(continued)
            for root, text in ([(REST, piece[len(continued) :])] if rest else [(START, piece)] + ([] if continued else [(REST, piece)])):
                node = root
                for c in text:
                    node = self.children[node].setdefault(c, len(ends))
                    if node == len(ends):
                        self.children.append({})
                        ends.append(False)
                if text:
                    ends[node] = True
        self.fail, self.taken = [NONE] * len(ends), [0] * len(ends)
        waiting = deque((root, c, child) for root in (START, REST) for c, child in self.children[root].items())
        while waiting:  # by depth: the links of shorter strings are known
            parent, c, node = waiting.popleft()
            if ends[node]:  # the whole string is the longest piece
                self.fail[node], self.taken[node] = REST, 1
            else:
                self.fail[node], self.taken[node] = self.after(parent, c)
            waiting.extend((node, d, child) for d, child in self.children[node].items())

    def after(self, node: int, c: str) -> tuple[int, int]:
        """Node of the rest of the node's string and ``c`` once at least one more piece is taken, and the pieces taken."""
        taken, at = self.taken[node], self.fail[node]
        while at != NONE and c not in self.children[at]:
            taken += self.taken[at]
            at = self.fail[at]
        return (NONE, 0) if at == NONE else (self.children[at][c], taken)

    def count(self, word: str) -> int:
        """Number of tokens of one word."""
        if not word:
            return 0
        if len(word) > MAX_WORD:
            return 1
        node, taken, children, fail = START, 0, self.children, self.fail
        for c in word:
            while c not in children[node]:
                if fail[node] == NONE:
                    return 1
                taken += self.taken[node]
                node = fail[node]
            node = children[node][c]
        while node != REST:  # what is left must be pieces, too
            if fail[node] == NONE:
                return 1
            taken += self.taken[node]
            node = fail[node]
        return taken


def word_pieces(text: Column) -> Column:
    """Words of a text: lower case without accents, signs and ideographs apart."""
    plain = F.lower(strip_accents(F.regexp_replace(text, r"[\x00\x{FFFD}]|[\p{Cc}\p{Cf}&&[^\t\n\r]]", "")))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def subword_counter(vocabulary: DataFrame, piece_col: str = "piece", continued: str = CONTINUED, specials: int = 0) -> Callable[[Column], Column]:
    """Column function text -> number of subword tokens, plus ``specials``, for the pieces of
    ``vocabulary``; ``continued`` marks continuation pieces ('' : every piece may
    stand anywhere).  A null text has none (null); null and empty pieces are ignored."""
    rows = vocabulary.select(piece_col).where(F.length(piece_col) > 0).limit(MAX_PIECES + 1).toPandas()
    if len(rows) > MAX_PIECES:
        raise ValueError(f"a vocabulary of more than {MAX_PIECES} pieces")
    pieces = rows[piece_col].tolist()

    @F.pandas_udf("int")
    def total(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = PieceTrie(pieces, continued)
        for words in batches:
            lists = pa.array(words, pa.list_(pa.string()))
            coded = lists.flatten().dictionary_encode()
            each = np.array([trie.count(w) for w in coded.dictionary.to_pylist()], np.int64)
            upto = np.append(0, np.cumsum(each[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)))
            size = np.array([0 if w is None else len(w) for w in words], np.int64)
            limits = np.append(0, np.cumsum(size))
            found = upto[limits[1:]] - upto[limits[:-1]] + specials
            yield pd.Series([None if w is None else int(n) for w, n in zip(words, found)], dtype="Int32")

    return lambda text: total(word_pieces(text))
