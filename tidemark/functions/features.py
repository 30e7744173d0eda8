"""Scalar text features in two profiles: ``train`` and ``serve``.

The profiles differ on purpose (normaliser, markdown and bracket sets, number
types); see ``feature_skew`` for a report of where they disagree.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.rules import PHRASE_FILE_KEYS, PHRASE_RULES

SCORES = [f"{group}_score" for group in PHRASE_RULES]
FLAGS = [f"has_{group}" for group in PHRASE_RULES]

# Feature names and their order, of which models and tables depend.
TRAIN_FEATURES = [
    "char_length", "word_count", "avg_word_length", "line_count", "sentence_count",
    "token_count", "token_word_ratio", "token_char_ratio",
    "over_128_tokens", "over_256_tokens", "over_512_tokens",
    "uppercase_ratio", "digit_ratio", "whitespace_ratio", "punctuation_ratio",
    "special_char_ratio", "non_ascii_ratio",
    "newline_count", "markdown_symbol_count", "has_code_block", "repeated_punct_count",
    "quote_count", "bracket_count", "colon_count", "semicolon_count",
    *SCORES, *FLAGS,
]

SERVE_FEATURES = [
    "token_count", "token_word_ratio", "whitespace_count", "whitespace_ratio",
    "punctuation_count", "punctuation_ratio", "special_char_ratio",
    "non_ascii_count", "non_ascii_ratio", "markdown_symbol_count", "has_code_block",
    "repeated_punct_count", "colon_count", "semicolon_count", "quote_count", "bracket_count",
    *SCORES, *FLAGS,
]

PCA_WIDTH = 32
PCA_FEATURES = [f"embed_pca_{i + 1}" for i in range(PCA_WIDTH)]

# Lexical part of the anomaly model's input, in model order.
ANOMALY_LEXICAL = [
    "token_count", "token_word_ratio", "whitespace_ratio", "punctuation_ratio",
    "special_char_ratio", "non_ascii_ratio", "markdown_symbol_count", "has_code_block",
    "repeated_punct_count", "quote_count", "bracket_count", "colon_count", "semicolon_count",
    *SCORES, *FLAGS,
]
ANOMALY_FEATURES = [*ANOMALY_LEXICAL, "embedding_norm", *PCA_FEATURES]

# str.isdigit() accepts decimal digits and these superscript-like digits; the
# intersection lets the many other characters fail on one cheap test.
# The character classes that the features count.
DIGITS = (
    r"\p{N}&&[\p{Nd}\xb2\xb3\xb9\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468"
    r"\u2474-\u247c\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff\u2776-\u277e\u2780-\u2788\u278a-\u2792"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}]"
)
MARKDOWN = {"train": "[`*_#>-]", "serve": r"[#*`>_\-\[\]()]"}
BRACKETS = {"train": r"[()\[\]{}]", "serve": r"[()\[\]{}<>]"}


def load_phrase_rules(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Phrase groups of a JSON object of lists, read and tidied by Spark: trimmed,
    lower-cased, blanks dropped.  A missing file, key or list gives an empty group (score 0)."""
    empty: dict[str, list[str]] = {group: [] for group in PHRASE_FILE_KEYS}
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty
    keys = {key: group for group, key in PHRASE_FILE_KEYS.items()}
    lists = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    phrases = F.from_json("value", "array<string>")
    tidy = F.filter(F.transform(phrases, lambda p: F.lower(F.trim(p))), lambda p: p != "")
    found = lists.where(F.col("key").isin(*keys)).select("key", tidy.alias("phrases")).collect()
    return empty | {keys[r["key"]]: r["phrases"] for r in found if r["phrases"] is not None}


def count_matches(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern))


def count_dropped(col: Column, pattern: str) -> Column:
    """Characters removed with the runs of a class: a count without match objects."""
    return F.length(col) - F.length(F.regexp_replace(col, pattern, ""))


def count_char(col: Column, char: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))


def phrase_score(lowered: Column, phrases: Sequence[str]) -> Column:
    hits = [F.contains(lowered, F.lit(p)).cast("int") for p in phrases if p]
    return reduce(lambda a, b: a + b, hits, F.lit(0))


def word_total(spaced: Column) -> Column:
    """Words of a text whose whitespace runs are single spaces."""
    return F.when(F.trim(spaced) == "", 0).otherwise(count_char(F.trim(spaced), " ") + 1)


def add_word_count(df: DataFrame, text_col: str = "prompt") -> DataFrame:
    """``char_length`` and ``word_count`` of the text as it stands."""
    spaced = df.withColumn("_spaced", X.collapse_ws(F.col(text_col)))
    return spaced.withColumns(
        {"char_length": F.length(text_col), "word_count": word_total(F.col("_spaced"))}
    ).drop("_spaced")


def text_features(
    df: DataFrame,
    profile: str = "train",
    text_col: str = "prompt",
    rules: Mapping[str, Sequence[str]] = PHRASE_RULES,
    add_special: bool = False,
    max_length: int = 20000,
    keep_text: bool = False,
    count_tokens: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Append the profile's feature columns; narrow, no shuffle, no Python.

    Long texts are scanned by a regex few times: the counts run on ``_marks``,
    the text with every run of letters, digits and spaces replaced by one space.
    Token counts are whitespace tokens, or those of ``count_tokens`` on the normalised
    text (see ``subword_counter``), plus two if ``add_special``.
    """
    if profile not in MARKDOWN:
        raise ValueError(f"Unknown profile: {profile}")
    serve = profile == "serve"
    raw = F.col(text_col)
    normal = X.normalize_serve(raw, max_length) if serve else X.normalize_train(raw)
    t, spaced, marks, lowered = (F.col(c) for c in ("_t", "_spaced", "_marks", "_lower"))
    n, words, tokens = F.col("_n"), F.col("_words"), F.col("_tokens")
    blanks, non_ascii = F.col("_blanks"), F.col("_non_ascii")
    size = F.greatest(n, F.lit(1)).cast("double")

    staged = df.withColumn("_t", normal)
    staged = staged.withColumns(
        {
            "_n": F.length(t),
            "_spaced": X.collapse_ws(t),
            "_marks": F.regexp_replace(t, r"(?U)[\p{L}\p{N}\s\x1c-\x1f]+", " "),
            "_lower": F.lower(t),
            "_non_ascii": F.when(F.octet_length(t) == F.length(t), 0).otherwise(
                count_dropped(t, r"[^\x00-\x7F]+")
            ),
        }
    )
    staged = staged.withColumns(
        {
            "_words": word_total(spaced),
            # collapsing removed every space of a run but one
            "_blanks": n - F.length(spaced) + count_char(spaced, " "),
        }
    )
    counted = words if count_tokens is None else count_tokens(t)
    staged = staged.withColumn("_tokens", counted + (2 if add_special else 0))

    zero_words = F.lit(0.0) if serve else tokens.cast("double")
    values: dict[str, Column] = {
        "char_length": n,
        "word_count": words,
        "avg_word_length": F.when(words == 0, 0.0).otherwise((n - blanks) / words.cast("double")),
        "line_count": count_char(t, "\n") + 1,
        "sentence_count": count_dropped(marks, "[.!?]+"),
        "token_count": tokens,
        "token_word_ratio": F.when(words == 0, zero_words).otherwise(tokens / words.cast("double")),
        "token_char_ratio": tokens / size,
        **{f"over_{k}_tokens": (tokens > k).cast("int") for k in (128, 256, 512)},
        "uppercase_ratio": count_dropped(t, r"\p{IsUppercase}+") / size,
        "digit_ratio": count_dropped(t, f"[{DIGITS}]+") / size,
        "whitespace_count": blanks,
        "whitespace_ratio": blanks / size,
        "punctuation_count": count_dropped(marks, r"\p{Punct}+"),
        "punctuation_ratio": count_dropped(marks, r"\p{Punct}+") / size,
        "special_char_ratio": (F.length(marks) - count_char(marks, " ")) / size,
        "non_ascii_count": non_ascii,
        "non_ascii_ratio": non_ascii / size,
        "newline_count": count_char(t, "\n"),
        "markdown_symbol_count": count_dropped(marks, MARKDOWN[profile] + "+"),
        "has_code_block": F.contains(marks, F.lit("```")).cast("int"),
        "repeated_punct_count": count_matches(marks, r"([!?.,:;])\1+"),
        "quote_count": count_dropped(marks, "[\"']+"),
        "bracket_count": count_dropped(marks, BRACKETS[profile] + "+"),
        "colon_count": count_char(marks, ":"),
        "semicolon_count": count_char(marks, ";"),
    }
    for group in PHRASE_RULES:
        score = phrase_score(lowered, rules.get(group, []))
        values[f"{group}_score"] = score
        values[f"has_{group}"] = (score > 0).cast("int")

    wanted = SERVE_FEATURES if serve else TRAIN_FEATURES
    picked = [values[c].cast("double") if serve else values[c] for c in wanted]
    extra = [t.alias("prompt_normalized")] if keep_text else []
    return staged.select(*df.columns, *extra, *[v.alias(c) for v, c in zip(picked, wanted)])


def feature_skew(df: DataFrame, id_col: str, text_col: str = "prompt") -> DataFrame:
    """Per shared feature: rows, rows where the two profiles differ, largest gap."""
    shared = [c for c in SERVE_FEATURES if c in TRAIN_FEATURES]
    base = df.select(id_col, text_col)
    train = text_features(base, "train", text_col)
    both = text_features(
        train.withColumnsRenamed({c: f"train_{c}" for c in TRAIN_FEATURES}), "serve", text_col
    )
    gaps = both.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.abs(F.col(c) - F.col(f"train_{c}").cast("double")).alias("gap"),
                    )
                    for c in shared
                ]
            )
        ).alias("g")
    ).select("g.*")
    return gaps.groupBy("feature").agg(
        F.count("*").alias("rows"),
        F.sum((F.col("gap") > 1e-9).cast("bigint")).alias("rows_differ"),
        F.max("gap").alias("max_gap"),
    )
