"""Fill-in-the-middle with piece tables.

A document is a piece table: an array of descriptors (buffer, start, length), in
code points, over two immutable buffers, its text and the row of sentinels.  A cut
splits the descriptor that holds the place; an arrangement puts the parts in another
order, each behind its sentinel; the inverse permutation puts them back.  Texts are
never edited.  All this is array work on a few integers, in the JVM; an output text
is spelled out once, where it is asked for.  Digests stream the descriptors: the
slices of a buffer go into the hash one by one, and the arranged text isn't built.

Rows stay where they are: no shuffle, and a task holds some texts at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_slices

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SENTINELS = "".join(MARKS)  # the second buffer
PLAIN_FROM, SPM_BELOW = 90, 20  # per cent
#: Parts (0 prefix, 1 middle, 2 suffix) in the order of the output.
ARRANGEMENTS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
MARK_OF = (0, 2, 1)  # sentinel of each part
PIECES = "array<struct<buffer:int,start:long,length:long>>"
RESULTS = ("n", "form", "pieces", "prefix_chars", "middle_chars", "fim_text")


def piece(buffer: int | Column, start: Column, length: Column) -> Column:
    buffer = F.lit(buffer) if isinstance(buffer, int) else buffer
    return F.struct(buffer.cast("int").alias("buffer"), start.cast("long").alias("start"), length.cast("long").alias("length"))


def cut(pieces: Column, at: Column) -> Column:
    """``pieces`` with the one that holds place ``at`` (code points from the start of
    the sequence) split there; at a border the earlier piece is split, into itself and
    an empty one, so that n cuts always make n pieces more."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(False).alias("done"), F.array().cast(PIECES).alias("out"))

    def step(state: Column, p: Column) -> Column:
        k = at - state["upto"]
        here = ~state["done"] & (k <= p["length"])
        both = F.array(piece(p["buffer"], p["start"], k), piece(p["buffer"], p["start"] + k, p["length"] - k))
        return F.struct(
            (state["upto"] + p["length"]).alias("upto"), (state["done"] | here).alias("done"),
            F.concat(state["out"], F.when(here, both).otherwise(F.array(p))).alias("out"),
        )

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def arranged(parts: Column, order: tuple[int, ...]) -> Column:
    """The parts in ``order``, each behind its sentinel."""
    out = []
    for i in order:
        at = sum(map(len, MARKS[: MARK_OF[i]]))
        out += [piece(1, F.lit(at), F.lit(len(MARKS[MARK_OF[i]]))), F.get(parts, F.lit(i))]
    return F.array(*out)


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(order.index(i) for i in range(len(order)))


def spelled(pieces: Column, text: Column) -> Column:
    """The sequence that the descriptors name, as a string."""

    def slice_of(p: Column) -> Column:
        source = F.when(p["buffer"] == 0, text).otherwise(F.lit(SENTINELS))
        return F.substring(source, (p["start"] + 1).cast("int"), p["length"].cast("int"))

    return F.array_join(F.transform(pieces, slice_of), "")


def draws(doc_id: Column, seed: str) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the hex sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1") -> DataFrame:
    """``docs`` with ``n`` (code points), ``form`` (plain, psm, spm), ``pieces`` (the
    descriptors of the output), ``prefix_chars`` and ``middle_chars`` (null if plain) and
    ``fim_text``, the output.

    Places and form come from the hash of the id, so a row that repeats an id and a
    text gets the same output, and a null id is hashed as an empty one.  A null text is
    an empty one; empty texts and texts that hold a sentinel stay plain.  Texts of any
    length are taken whole; no row is dropped.  Columns called as the results are
    replaced, others kept."""
    names = [c for c in docs.columns if c not in RESULTS]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.struct(*names).alias("_row"), text.alias("_text"), F.array(*draws(F.col(id_col), seed)).alias("_h"))
    sized = given.withColumn("n", F.length("_text").cast("long"))
    h = [F.get("_h", F.lit(i)) for i in range(4)]
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains("_text", F.lit(m))
    form = F.when((F.col("n") == 0) | marked | (h[2] % 100 >= PLAIN_FROM), "plain").when(h[3] % 100 < SPM_BELOW, "spm").otherwise("psm")
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    drawn = sized.select("_row", "_text", "n", form.alias("form"), F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"))
    whole = F.array(piece(0, F.lit(0), F.col("n")))
    # the later place first: the earlier one then lies in the first piece
    parts = drawn.withColumn("_whole", whole).withColumn("_parts", cut(cut(F.col("_whole"), F.col("_b")), F.col("_a")))
    pieces = F.col("_whole")
    for name, order in ARRANGEMENTS.items():
        pieces = F.when(F.col("form") == name, arranged(F.col("_parts"), order)).otherwise(pieces)
    split = F.col("form") != "plain"
    out = parts.select(
        "_row", "_text", "n", "form", pieces.alias("pieces"),
        F.when(split, F.col("_a")).alias("prefix_chars"), F.when(split, F.col("_b") - F.col("_a")).alias("middle_chars"),
    )
    output = F.when(F.col("form") == "plain", F.col("_text")).otherwise(spelled(F.col("pieces"), F.col("_text")))
    row = [F.col(f"_row.{c}").alias(c) for c in names]
    return out.select(*row, *RESULTS[:-1], output.alias("fim_text"))


def restoring_pieces(output: Column, form: Column) -> Column:
    """Descriptors of the document over its output: the stretches behind the
    sentinels, put back by the inverse permutation.  From output and form alone; null
    if the sentinels of the form don't stand in the output.  A text without sentinels
    can't make one with its neighbours, since each starts with the only '<' it has."""
    out = F.when(form == "plain", F.array(piece(0, F.lit(0), F.length(output))))
    for name, order in ARRANGEMENTS.items():
        at = [F.locate(MARKS[MARK_OF[i]], output).cast("long") for i in order]  # from 1; 0 if absent
        begin = [p + len(MARKS[MARK_OF[i]]) - 1 for p, i in zip(at, order)]
        end = [p - 1 for p in at[1:]] + [F.length(output).cast("long")]
        found = [piece(0, x, y - x) for x, y in zip(begin, end)]
        sound = (at[0] == 1) & (at[1] > begin[0]) & (at[2] > begin[1])
        out = F.when((form == name) & sound, F.array(*[found[j] for j in inverse(order)])).otherwise(out)
    return out


def restored(df: DataFrame, output_col: str = "fim_text", form_col: str = "form", text_col: str = "text") -> DataFrame:
    """``df`` with the document rebuilt from output and form in ``text_col``."""
    pieces = df.withColumn("_back", restoring_pieces(F.col(output_col), F.col(form_col)))
    return pieces.withColumn(text_col, spelled(F.col("_back"), F.col(output_col))).drop("_back")


def streamed(text: str, pieces: list[dict]) -> str:
    """Hex sha256 of the sequence that the descriptors name."""
    digest = hashlib.sha256()
    for p in pieces:
        source = SENTINELS if p["buffer"] else text
        digest.update(source[p["start"] : p["start"] + p["length"]].encode())
    return digest.hexdigest()


def digests(df: DataFrame, buffers: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a hex sha256 in each key of ``buffers``: that of the sequence named
    by (text column, descriptor column), null if the descriptors are.  The columns
    named are dropped; one pass in Arrow batches."""
    used = list(dict.fromkeys(c for pair in buffers.values() for c in pair))
    kept = [c for c in df.columns if c not in used and c not in buffers]
    given = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], *used)
    schema = given.select(*[f"k{i}" for i in range(len(kept))]).schema
    for name in buffers:
        schema = schema.add(name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                cols = {c: part.column(len(kept) + i).to_pylist() for i, c in enumerate(used)}
                more = []
                for text, pieces in buffers.values():
                    pairs = zip(cols[text], cols[pieces])
                    more.append(pa.array([None if p is None else streamed(t or "", p) for t, p in pairs], pa.string()))
                yield pa.RecordBatch.from_arrays(part.columns[: len(kept)] + more, names=schema.names)

    return given.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(kept)})


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1") -> DataFrame:
    """Per document: ``n, form, prefix_chars, middle_chars`` and the digests of the
    output and of the text rebuilt from output and form."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = fill_in_middle(given, "doc_id", "text", seed)
    back = made.withColumn("back", restoring_pieces(F.col("fim_text"), F.col("form")))
    out = digests(back, {"output_sha256": ("text", "pieces"), "restored_sha256": ("fim_text", "back")})
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


SQL = f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT doc_id, text, length(text) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM h),
c AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {PLAIN_FROM}
             THEN 'plain' WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(text, 1, a) AS x, substring(text, a + 1, b - a) AS y, substring(text, b + 1, n - b) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
         ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
