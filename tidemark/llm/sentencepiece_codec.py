"""Encoding and decoding with a SentencePiece model of the merge (BPE) type.

The encoder keeps an agenda of adjacent symbol pairs that form a piece, ordered by
score and then from the left; the best pair is merged, its new neighbours are put
on the agenda, stale entries are skipped.  Symbols that are no piece at the end
become byte pieces.  No piece holds the space mark after another character, so a
text is encoded by its stretches "space marks, then other characters", cut before line
breaks, too, where no piece joins them to what stands before: each distinct stretch goes through the agenda once, as long as the memory of a worker, two
generations of ``GENERATION`` bytes, keeps it.  The new short stretches of a slice of rows
go through their agendas side by side, in arrays: each round takes every stretch's best
pair.  Every stretch that enters the memory is also encoded by the sentencepiece library, batch by batch; a difference stops
the job.  All stretches share one object for an id.  The library decodes the ids of each batch.

The model travels to the tasks as bytes; its size is that of the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_slices, worker_cache

MARK = "▁"
GENERATION = 32 << 20  # bytes of stretches and ids, estimated; a worker keeps two generations
SHORT, NEVER = 48, 1 << 60
PLACE = 6  # bits for a position in a short stretch
IN_A_ROW = 64  # stretches that the library encodes as one text
ABREAST = 16384  # stretches merged at once


class Pairs:
    """(left, right) symbols, as numbers -> number of the piece they form, or 0: an array
    of keys and one of pieces, each key in the first free slot from its hash on."""

    def __init__(self, found: dict[tuple[int, int], int]) -> None:
        self.bits = max(4, (4 * len(found)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        key, made = np.array([x << 32 | y for x, y in found], np.int64), np.array(list(found.values()), np.int32)
        slot = self.slots(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.made[slot[free]] = key[free], made[free]
            rest = np.ones(len(key), bool)
            rest[free] = False
            key, made, slot = key[rest], made[rest], self.after(slot[rest])

    def slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def after(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.bits) - 1)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = self.slots(key)
        there = self.keys[slot]
        again = np.flatnonzero((there != key) & (there >= 0))
        while len(again):
            slot[again] = self.after(slot[again])
            there = self.keys[slot[again]]
            again = again[(there != key[again]) & (there >= 0)]
        return self.made[slot]  # a free slot says 0


class Codec:
    def __init__(self, model: bytes) -> None:
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(lib.get_piece_size())
        normal = [i for i in ids if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.piece = {i: lib.id_to_piece(i) for i in ids}
        self.told = pa.array([str(i) for i in ids])
        self.id = {self.piece[i]: i for i in normal}
        level = {s: r for r, s in enumerate(sorted({lib.get_score(i) for i in normal}, reverse=True))}
        self.level = {self.piece[i]: level[lib.get_score(i)] for i in normal}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(lib.is_byte(i) for i in self.bytes):
            raise ValueError("the model has no byte pieces")
        if any(MARK in p.lstrip(MARK) for p in self.id) or lib.decode(lib.encode("  x  \ufb01 ")) != "  x  \ufb01 ":
            raise ValueError("pieces with inner spaces, or a normaliser that changes texts, aren't supported")
        self.joined = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.end = lib.eos_id()
        self.lines = not any(pair[1] == "\n" for pair in self.joined)  # no piece joins a line break to what stands before
        # symbols as numbers: pieces, then ASCII and characters that only stand in pieces; 0 is any other character
        number = {p: i for i, p in enumerate(self.id, 1)}
        for c in sorted({*map(chr, range(128)), *"".join(self.id)} - number.keys()):
            number[c] = len(number) + 1
        self.ints = np.array([*ids, -1], object)  # one object for each id, however many stretches hold it
        self.piece_id = np.full(len(number) + 1, -1, np.int64)
        self.piece_id[1 : len(self.id) + 1] = list(self.id.values())
        for b in range(128):
            if chr(b) not in self.id:
                self.piece_id[number[chr(b)]] = self.bytes[b]
        self.number = np.zeros(max(ord(c) for c in number if len(c) == 1) + 2, np.int32)
        for c in number:
            if len(c) == 1:
                self.number[ord(c)] = number[c]
        halves = ((p, number.get(p[:i]), number.get(p[i:])) for p in self.id for i in range(1, len(p)))
        self.pairs = Pairs({(x, y): number[p] for p, x, y in halves if x and y})
        # levels by number, that of no piece behind all others; they leave room for a position
        self.order = np.full(len(number) + 1, len(level), np.int32 if len(level) < 1 << 24 else np.int64)
        for p in self.id:
            self.order[number[p]] = self.level[p]
        self.never = len(level) << PLACE

    def merged(self, text: str) -> list[int]:
        """Ids of a stretch whose spaces are marks."""
        symbols = self.merged_short(text) if len(text) <= SHORT else self.merged_long(text)
        out: list[int] = []
        for s in symbols:
            found = self.id.get(s)
            if found is None:
                out.extend(self.bytes[b] for b in s.encode())
            else:
                out.append(found)
        return out

    def merged_short(self, text: str) -> list[str]:
        """The agenda as a list beside the symbols: its least entry, the leftmost of
        equal ones, is found by two scans, which for few symbols beats a heap."""
        symbols, get = list(text), self.level.get
        agenda = [get(x + y, NEVER) for x, y in zip(text, text[1:])]
        while agenda:
            least = min(agenda)
            if least == NEVER:
                break
            i = agenda.index(least)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], NEVER)
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], NEVER)
        return symbols

    def merged_long(self, text: str) -> list[str]:
        symbols, n = list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        level, agenda = self.level, []
        for i in range(n - 1):
            r = level.get(symbols[i] + symbols[i + 1])
            if r is not None:
                agenda.append((r, i, symbols[i] + symbols[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != len(piece):
                continue
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = level.get(piece + symbols[k])
                if r is not None:
                    heapq.heappush(agenda, (r, i, piece + symbols[k]))
            k = before[i]
            if k >= 0:
                r = level.get(symbols[k] + piece)
                if r is not None:
                    heapq.heappush(agenda, (r, k, symbols[k] + piece))
        return [s for s in symbols if s]

    def merged_many(self, texts: list[str]) -> dict[str, tuple[int, ...]]:
        """Texts of 1 to ``SHORT`` characters and their ids.  A round takes all texts that have
        ``n`` symbols now, as columns, and merges each one's best pair, so they have one fewer or
        are done.  ``agenda`` holds the level of a symbol and the next one with its position in
        the low bits: the least entry of a text is its best pair, the leftmost of equal ones."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        all_symbols = self.number[np.minimum(codes, len(self.number) - 1)]
        starts = np.cumsum(size) - size
        text, symbol = np.zeros(0, np.int64), np.zeros((size.max(initial=0), 0), np.int32)
        made = agenda = symbol[1:]
        found: dict[str, tuple[int, ...]] = {}
        for n in range(len(symbol), 0, -1):
            new = np.flatnonzero(size == n)
            if len(new):
                fresh = all_symbols[starts[new] + np.arange(n)[:, None]]
                pieces = self.pairs(fresh[:-1].ravel(), fresh[1:].ravel()).reshape(n - 1, len(new))
                entries = self.entry(pieces, np.arange(n - 1, dtype=np.int32)[:, None])
                text = np.concatenate([text, new])
                symbol, made, agenda = (np.concatenate(x, axis=1) for x in ((symbol, fresh), (made, pieces), (agenda, entries)))
            least = agenda.min(axis=0, initial=self.never)
            going = np.flatnonzero(least < self.never)
            if len(going) < len(text):
                done = np.flatnonzero(least >= self.never)
                self.ended([texts[i] for i in text[done].tolist()], symbol[:, done], found)
                text, least = text[going], least[going]
                symbol, made, agenda = (x[:, going] for x in (symbol, made, agenda))
            if not len(text):
                symbol, made, agenda = symbol[1:], made[1:], agenda[1:]
                continue
            at, column, place = least & ((1 << PLACE) - 1), np.arange(len(text)), np.arange(n, dtype=np.int32)[:, None]
            symbol[at, column] = made[at, column]
            symbol = np.where(place[: n - 1] > at, symbol[1:], symbol[:-1])
            behind = place[: n - 2] > at
            made, agenda = np.where(behind, made[1:], made[:-1]), np.where(behind, agenda[1:] - 1, agenda[:-1])
            for near, off in ((np.flatnonzero(at < n - 2), 0), (np.flatnonzero(at > 0), 1)):
                i = at[near] - off
                pieces = self.pairs(symbol[i, near], symbol[i + 1, near])
                made[i, near], agenda[i, near] = pieces, self.entry(pieces, i)
        return found

    def entry(self, piece: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.order[piece] << PLACE | place

    def ended(self, texts: list[str], symbol: np.ndarray, found: dict[str, tuple[int, ...]]) -> None:
        """Puts the ids of texts, whose symbols are columns, into ``found``."""
        ids = self.piece_id[symbol]
        found.update(zip(texts, map(tuple, self.ints[ids.T].tolist())))
        for i in np.flatnonzero((ids < 0).any(axis=0)).tolist():  # with characters of several bytes that are no pieces
            found[texts[i]] = tuple(self.ints[self.merged(texts[i])].tolist())

    def told_of(self, ids: list[list[int]], n: np.ndarray) -> pa.Array:
        """Each list of ``n`` ids as decimal numbers joined by one space."""
        flat = self.told.take(pa.array(np.fromiter(chain.from_iterable(ids), np.int32, n.sum())))
        return pc.binary_join(pa.LargeListArray.from_arrays(np.append(0, np.cumsum(n)), flat), " ")

    def parts(self, text: str) -> list[str]:
        """``text`` cut between characters that are neighbours in no piece."""
        joined = self.joined
        inner = [x + y in joined for x, y in zip(text, text[1:])]
        if all(inner):
            return [text]
        cuts = [i for i, one in enumerate(inner, 1) if not one]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]


class Memory(dict):
    """Stretch, or part of one, -> its ids."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec, self.old, self.fresh, self.size = codec, {}, [], 0

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.old.get(text)
        if ids is None:
            parts = self.codec.parts(text)
            ids = self.ids_of(text) if len(parts) == 1 else tuple(chain.from_iterable(map(self.part, parts)))
            if text != MARK:  # of which the library makes nothing
                self.fresh.append(text)
        self[text] = ids
        self.size += 200 + 2 * len(text) + 8 * len(ids)
        return ids

    def learn(self, texts: set[str]) -> None:
        """Takes in the short ones of ``texts`` that neither generation holds."""
        new = [t for t in texts if t not in self and t not in self.old and t != MARK and len(t) <= SHORT]
        for at in range(0, len(new), ABREAST):
            found = self.codec.merged_many(new[at : at + ABREAST])
            self.update(found)
            self.size += 200 * len(found) + 2 * sum(map(len, found)) + 8 * sum(map(len, found.values()))
        self.fresh += new

    def ids_of(self, text: str) -> tuple[int, ...]:
        return tuple(self.codec.ints[self.codec.merged(text)].tolist())

    def part(self, text: str) -> tuple[int, ...]:
        ids = self.get(text)
        if ids is None:
            ids = self[text] = self.ids_of(text)
            self.size += 200 + 2 * len(text) + 8 * len(ids)
        return ids

    def check(self) -> None:
        """The library's view of the stretches that are new since the last call."""
        if self.fresh:
            # stretches in a row are a text with the same stretches, but for those of marks only
            alone = [[t] for t in self.fresh if t[-1] == MARK]
            rows = [t for t in self.fresh if t[-1] != MARK]
            first = [MARK + "a"]  # which a stretch that begins with a line break can follow
            rows = [first + rows[i : i + IN_A_ROW] for i in range(0, len(rows), IN_A_ROW)] + alone
            plain = ["".join(r)[1:].replace(MARK, " ") for r in rows]  # the library puts the first mark
            for row, ids in zip(rows, self.codec.library.encode(plain, num_threads=1)):
                if ids != list(chain.from_iterable(map(self.__getitem__, row))):
                    alone = (t if t[0] == MARK else first[0] + t for t in row)
                    said = (self.codec.library.encode(t[1:].replace(MARK, " ")) for t in alone)
                    told = ([*(() if t[0] == MARK else self[first[0]]), *self[t]] for t in row)
                    text = next((t for t, x, y in zip(row, said, told) if x != y), "".join(row))
                    raise ValueError(f"encoding differs from the library's for {text!r}")
            self.fresh.clear()
        if self.size > GENERATION:
            self.old = dict(self)
            self.clear()
            self.size = 0


STRETCH = re.compile(f"{MARK}+[^{MARK}]*")
LINE_STRETCH = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")


def stretches(text: str, lines: bool = False) -> list[str]:
    """The text, with the mark in front that the model adds, in stretches; ``lines``: cut
    before line breaks, too."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return (LINE_STRETCH if lines else STRETCH).findall(MARK + text.replace(" ", MARK))
    text = MARK + text.replace(" ", " " + MARK)
    return (text.replace("\n", " \n") if lines else text).split(" ")


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", add_end: bool = True) -> DataFrame:
    """``docs`` without ``text_col``, with ``ids`` (decimal ids joined by one space),
    ``n_tokens`` and ``decoded`` (the text that the ids spell).

    A null text is an empty one: only the end id, or no id.  Texts of any length
    are encoded whole.  Rows are neither dropped nor merged; other columns stay,
    but columns called as the results are replaced.  No shuffle."""
    with open(model_path, "rb") as f:
        model = f.read()
    key = "sentencepiece-" + hashlib.sha256(model).hexdigest()
    results = ("ids", "n_tokens", "decoded")
    names = [c for c in docs.columns if c != text_col and c not in results]
    given = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.col(text_col).cast("string").alias("text"))
    kept = given.drop("text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_cache(key, lambda: Memory(Codec(model)))
        codec = memory.codec
        end = [codec.end] if add_end else []
        for batch in batches:
            for part in byte_slices(batch, 1 << 20):
                texts = part.column(part.num_columns - 1).to_pylist()
                cut = [stretches(x or "", codec.lines) for x in texts]
                memory.learn(set(chain.from_iterable(cut)))
                ids = [list(chain.from_iterable(map(memory.__getitem__, x))) for x in cut]
                memory.check()
                decoded = codec.library.decode(ids, num_threads=1)
                for x in ids:
                    x += end
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                more = [codec.told_of(ids, n), pa.array(n), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + more, part.schema.names[:-1] + list(results))

    schema = kept.add("ids", "string").add("n_tokens", "long").add("decoded", "string")
    return given.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(names)})


def id_array(ids: Column) -> Column:
    """The ``ids`` text as an array of int."""
    return F.when(ids == "", F.array().cast("array<int>")).otherwise(F.split(ids, " ").cast("array<int>"))
