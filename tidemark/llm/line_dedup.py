"""Removal of boilerplate lines by their frequency relative to the site.

Pages are grouped by host.  A line is boilerplate of its host if the share of the
host's pages that hold it exceeds ``ratio`` and at least ``min_pages`` pages do.
Lines are counted with partial sums per task on (host, digest), so that a host
with most pages is no hot key.  A host has at most (distinct lines per page) /
``ratio`` boilerplate lines, by counting: the lists joined back are short
whatever the corpus size.  The join is on the host; the lists are broadcast only
after counting them, else Spark splits the partitions of large hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, stored

RATIO, MIN_PAGES = 0.1, 5
BLANK = " \t\r\x0b\x0c"


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """``host, digests``: md5 of the boilerplate lines of each host that has any."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")
    rows = pages.select(host, F.col(text_col).cast("string").alias("text"))
    lines = F.array_distinct(F.transform(F.split("text", "\n"), stripped))
    each = rows.select("host", F.explode(lines).alias("line")).where("line <> ''")
    counts = each.groupBy("host", F.unhex(F.md5("line")).alias("digest")).agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    frequent = counts.join(totals, "host").where(F.col("n") > F.col("pages") * F.lit(float(ratio)))
    return frequent.groupBy("host").agg(F.collect_list("digest").alias("digests"))


def drop_boilerplate_lines(
    pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text_col``, and the columns
    ``n_lines`` (not blank ones, before) and ``n_dropped``.

    Lines end at a line feed and are compared without white space at their ends;
    blank lines stay.  A null host is the host ''.  A null text stays null with no
    lines; an empty one stays empty.  Rows are never dropped, nor merged if they
    repeat, also if all lines of a text go.  Other columns are kept; a column
    called ``n_lines`` or ``n_dropped`` is replaced."""
    lists = stored(boilerplate(pages, host_col, text_col, ratio, min_pages), "boilerplate")
    names = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    key = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    given = pages.select(F.struct(*names).alias("_page"), key.alias("host"))
    lines = F.split(F.col(f"_page.{text_col}").cast("string"), "\n")
    joined = given.join(broadcast_if_small(lists, 20_000), "host", "left")

    def kept(line: Column) -> Column:
        return ~F.array_contains("digests", F.unhex(F.md5(stripped(line))))

    full = F.filter(lines, lambda x: stripped(x) != "")
    left = F.when(F.col("digests").isNull(), lines).otherwise(F.filter(lines, lambda x: (stripped(x) == "") | kept(x)))
    out = joined.select("_page", full.alias("_full"), left.alias("_left"), lines.alias("_lines"))
    n = F.coalesce(F.size("_full"), F.lit(0)).cast("long")
    dropped = F.coalesce(F.size("_lines") - F.size("_left"), F.lit(0)).cast("long")
    text = F.array_join("_left", "\n")
    page = [text.alias(c) if c == text_col else F.col(f"_page.{c}").alias(c) for c in names]
    return out.select(*page, n.alias("n_lines"), dropped.alias("n_dropped"))


SQL = f"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(text, chr(10))) AS raw FROM documents),
t AS (SELECT doc_id, host, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l),
p AS (SELECT coalesce(source, '') AS host, count(*) AS pages FROM documents GROUP BY 1),
b AS (SELECT host, line FROM (SELECT DISTINCT * FROM t) JOIN p USING (host) WHERE line <> ''
      GROUP BY host, line, pages HAVING count(*) >= {MIN_PAGES} AND count(*) > pages * {RATIO}::DOUBLE),
x AS (SELECT d.doc_id, coalesce(d.source, '') AS host, unnest(string_split(d.text, chr(10))) AS raw,
             generate_subscripts(string_split(d.text, chr(10)), 1) AS i FROM documents d),
y AS (SELECT x.doc_id, x.raw, x.i, trim(x.raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line, b.line IS NOT NULL AS gone
      FROM x LEFT JOIN b ON b.host = x.host AND b.line = trim(x.raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))
SELECT d.doc_id, coalesce(any_value(v.text), CASE WHEN d.text IS NOT NULL THEN '' END) AS text,
       coalesce(any_value(v.n_lines), 0) AS n_lines, coalesce(any_value(v.n_dropped), 0) AS n_dropped
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone) AS text,
         count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped
  FROM y GROUP BY doc_id) v USING (doc_id)
GROUP BY d.doc_id, d.text
"""
