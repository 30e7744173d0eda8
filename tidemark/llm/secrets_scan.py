"""Secret scans: fixed patterns, and Markov models of characters.

Patterns find assigned values, access keys and long hexadecimal runs.  Beside
them, each remaining key-like run of characters is scored: the log-likelihood
ratio per character of two first-order Markov models, one of random strings, one
of ordinary identifiers; runs above ``RATIO`` are added as spans of kind "model".

The models are trained from all distinct texts, labelled by the patterns: distinct
values they find are random strings, words without digits, by their frequency, are
identifiers.  Copies of a text count once; values and words are pre-aggregated, and the
counts of adjacent characters are 128 x 128 at any size.  All work is done by DataFrame expressions; the
pieces between matches give their positions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds; group 2 of "assign" is the value.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters and more: a shorter run has no longer rest
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "model")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = r"[A-Za-z0-9+/_=-]{20,}"

ALPHABET = 128
RATIO, SMOOTH = 0.5, 0.5


SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def matches(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Array of (start, kind, end, value) of all matches, leftmost first and without
    overlap; ``value`` is the text of ``group``.

    Matches and the pieces between them come as whole arrays, once a text; their
    lengths give the places."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.zip_with(between, found, lambda b, f: F.struct(F.length(b).alias("gap"), F.length(f).alias("size"), f.alias("value")))
    if group:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        sizes = F.zip_with(sizes, values, lambda x, v: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), v.alias("value")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + x["size"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(F.filter(sizes, lambda x: x["size"].isNotNull()), empty, step, lambda acc: acc["spans"])


def base_spans(text: Column) -> dict[str, Column]:
    lowered = F.lower(text)
    hint = F.lit(False)
    for word in KEYWORDS:
        hint = hint | F.contains(lowered, F.lit(word))
    none = F.array().cast(SPANS)
    assigned = F.filter(matches(text, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= 8)
    return {
        "assign": F.when(hint, assigned).otherwise(none),
        "access": F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS, "access")).otherwise(none),
        "hex": F.when(text.rlike(HEX), matches(text, HEX, "hex")).otherwise(none),
    }


def bigrams(strings: DataFrame) -> DataFrame:
    """``random, code, n``: counts of adjacent characters of ``s``, each ``n`` times, 128 * first + second."""
    i = F.explode(F.sequence(F.lit(1), F.length("s") - 1))
    each = strings.where(F.length("s") > 1).select("random", "s", "n", i.alias("i"))
    code = F.ascii(F.substring("s", F.col("i"), F.lit(1))) * ALPHABET + F.ascii(F.substring("s", F.col("i") + 1, F.lit(1)))
    return each.select("random", "n", code.alias("code")).where((F.col("code") >= 0) & (F.col("code") < ALPHABET * ALPHABET)).groupBy("random", "code").agg(F.sum("n").alias("n"))


def labelled_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``random, s, n``: the distinct values that the patterns find, once each, and the words
    that hold no digit with their number, of all distinct texts."""
    text = docs.select(F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0).distinct()
    lowered, none = F.lower("text"), F.array().cast("array<string>")
    hint = F.lit(False)
    for word in KEYWORDS:
        hint = hint | F.contains(lowered, F.lit(word))
    every = lambda pattern, group=0: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    found = F.concat(
        F.when(hint, every(ASSIGN, 2)).otherwise(none),
        F.when(F.col("text").rlike(HEX), every(HEX)).otherwise(none),
        F.when(F.contains("text", F.lit("AKIA")), every(ACCESS)).otherwise(none),
    )
    values = F.transform(F.filter(found, lambda s: F.length(s) >= 12), lambda s: F.struct(F.lit(True).alias("random"), s.alias("s")))
    names = F.transform(every(r"[A-Za-z_]{4,}"), lambda s: F.struct(F.lit(False).alias("random"), s.alias("s")))
    counted = text.select(F.explode(F.concat(values, names)).alias("x")).groupBy("x.random", "x.s").agg(F.count("*").alias("n"))
    return counted.withColumn("n", F.when(F.col("random"), F.lit(1)).otherwise(F.col("n")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random against identifier; a
    table of 128 x 128 whatever the samples."""
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in bigrams(samples).collect():
        counts[r["random"]][r["code"]] = r["n"]
    out = [0.0] * (ALPHABET * ALPHABET)
    alphabet = [c for c in range(ALPHABET) if chr(c).isalnum() or chr(c) in "+/_=-"]
    for a in alphabet:
        total = {k: sum(counts[k].get(a * ALPHABET + b, 0) for b in alphabet) + SMOOTH * len(alphabet) for k in counts}
        for b in alphabet:
            p = {k: (counts[k].get(a * ALPHABET + b, 0) + SMOOTH) / total[k] for k in counts}
            out[a * ALPHABET + b] = round(math.log(p[True] / p[False]), 4)
    return out


def ratio(s: Column, model: Column) -> Column:
    """Mean log-likelihood ratio of the pairs of characters of ``s``."""
    code = lambda i: F.ascii(F.substring(s, i, F.lit(1))) * ALPHABET + F.ascii(F.substring(s, i + 1, F.lit(1)))
    total = F.aggregate(F.sequence(F.lit(1), F.length(s) - 1), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.get(model, code(i)), F.lit(0.0)))
    return total / (F.length(s) - 1)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None, threshold: float = RATIO) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and the arrays ``assign, access, hex,
    model`` of (start, kind, end, value), starts and exclusive ends in code points.

    Null and empty texts have no spans.  Without ``model``, it is trained on
    ``docs``; if no value or no word is found, all ratios are near zero and no span is added.
    A model span never repeats a base span's place; base spans stay."""
    if model is None:
        model = train(labelled_samples(docs, text_col))
    table = F.split(F.lit(",".join(f"{x:g}" for x in model)), ",").cast("array<double>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    based = rows.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    keylike = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (ratio(v, table) > threshold)
    likely = F.filter(matches(F.col("text"), RUN, "model"), lambda s: keylike(s["value"]))
    base = F.concat("assign", "access", "hex")
    inside = lambda s: F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    added = F.when(F.col("text").rlike(r"[A-Za-z0-9+/_=-]{20}"), likely).otherwise(F.array().cast(SPANS))
    return based.select("doc_id", "assign", "access", "hex", F.filter(added, lambda s: ~inside(s)).alias("model"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, by start and then by kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), text), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, F.col("model"))).alias("spans"),
    )
