"""Removes lines that most pages of a site share.

A line's ratio is the number of the host's pages that contain it, divided by all pages of
that host. Lines above the ratio are boilerplate of the site and are dropped from its pages.
Texts are never shuffled with their lines: lines travel as hashes, and only the positions to
drop return to the documents.

Lines are the parts between line feeds, compared without surrounding blanks; lines without a
character are kept, as they are layout. Nulls: a null text has no lines and stays null, a
null host is a host of its own. A line must stand in ``least`` pages of a host in any case, so
small hosts lose nothing by chance.

What a page is: in ``line_report``, as in its SQL, every row, repeated or not. In ``cleaned``,
the pipeline's stage, a group of copies is one page of its host: equal texts by their hash, near
copies by ``near_dup`` among the pages of which a tenth (``SHARED``) stands elsewhere on the
host. Otherwise a group above the ratio would lose the whole text that its copies share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staysearch.llm import near_dup
from staysearch.llm.common import saved

RATIO = 0.02
LEAST = 5
SHARED = 0.1
BLANKS = " \t\r\x0b\x0c"


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_set(text: Column) -> Column:
    """line (hash) and chars of each different line with a character."""
    full = F.filter(_lines(text), lambda x: _stripped(x) != "")
    return F.array_distinct(
        F.transform(
            full, lambda x: F.struct(F.xxhash64(_stripped(x)).alias("line"), F.char_length(_stripped(x)).alias("chars"))
        )
    )


def _above(hosts: DataFrame, lines: DataFrame, ratio: float, least: int) -> DataFrame:
    """``boilerplate`` of one row (host) a page and one row (host, line) a page and line.

    Counting is combined on the map side, so neither a hot host nor a hot line meets in one
    task.
    """
    totals = hosts.groupBy("host").agg(F.count("*").alias("host_pages"))
    counted = (
        lines.groupBy("host", "line").agg(F.count("*").alias("line_pages")).where(F.col("line_pages") >= least)
    )
    return (
        counted.join(totals, counted.host.eqNullSafe(totals.host))
        .select(
            counted.host, "line", "line_pages", "host_pages", (F.col("line_pages") / F.col("host_pages")).alias("ratio")
        )
        .where(F.col("ratio") > ratio)
    )


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """host, line hash, pages and ratio of every boilerplate line; each row is a page.

    ``pages`` has ``host`` and ``text``.
    """
    lines = pages.select("host", F.explode(F.transform(_line_set(F.col("text")), lambda x: x["line"])).alias("line"))
    return _above(pages.select("host"), lines, ratio, least)


def boilerplate_of_groups(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``boilerplate`` that counts a group of copies and near copies as one page of its host."""
    keyed = pages.select("host", F.xxhash64("host", F.col("host").isNull(), "text").alias("key"), "text")
    described = keyed.select("host", "key", _line_set(F.col("text")).alias("lines"))
    repeated = saved(keyed.groupBy("key").count().where("count > 1").select("key"), "repeated")
    once = described.join(repeated, "key", "left_anti").unionByName(
        described.join(repeated, "key", "left_semi").dropDuplicates(["key"])
    )
    groups = _near_copies(keyed, once, least)
    alone = once.join(groups, "key", "left_anti")
    grouped = once.join(groups, "key")
    line = F.explode("lines.line").alias("line")
    return _above(
        alone.select("host").unionAll(grouped.select("host", "unit").distinct().select("host")),
        alone.select("host", line).unionAll(
            grouped.select("host", "unit", line).distinct().select("host", "line")
        ),
        ratio,
        least,
    )


def _near_copies(keyed: DataFrame, once: DataFrame, least: int) -> DataFrame:
    """key and unit (the smallest key of its near copies) of the pages that may have some: those
    of which a tenth consists of lines that ``least`` different pages of the host have."""
    rows = once.select(
        "host", "key", F.expr("aggregate(lines.chars, 0L, (a, x) -> a + x)").alias("chars"), F.explode("lines").alias("l")
    ).select("host", "key", "chars", "l.line", F.col("l.chars").alias("line_chars"))
    often = saved(
        rows.groupBy(F.col("host").alias("site"), F.col("line").alias("common"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least)
        .drop("n"),
        "often",
    )
    wanted = saved(
        rows.join(often, rows.host.eqNullSafe(F.col("site")) & (F.col("line") == F.col("common")))
        .groupBy("key")
        .agg(F.sum("line_chars").alias("shared"), F.max("chars").alias("chars"))
        .where(F.col("shared") >= SHARED * F.col("chars"))
        .select("key"),
        "shared",
    )
    texts = keyed.join(wanted, "key", "left_semi").select(F.col("key").alias("doc_id"), "text")
    found = near_dup.near_duplicates(saved(texts.dropDuplicates(["doc_id"]), "shared-texts"))
    return saved(found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("unit")), "groups")


def without_boilerplate(
    docs: DataFrame,
    host: Column,
    text: str = "text",
    ratio: float = RATIO,
    least: int = LEAST,
    found: Callable[[DataFrame, float, int], DataFrame] = boilerplate,
) -> DataFrame:
    """``doc`` (the whole input row), ``kept_text``, ``n_lines`` and ``n_dropped``.

    ``found`` gives the boilerplate lines of host and text.

    Rows are found again by a hash of id-independent content: equal rows have equal lines,
    so they share a decision and need no key of their own.
    """
    rows = docs.select(F.struct("*").alias("doc"), host.alias("host"), F.col(text).alias("text")).withColumn(
        "row_key", F.struct(F.xxhash64("host", "text"), F.crc32(F.col("text").cast("binary")).alias("crc"))
    )
    lines = rows.select("row_key", "host", F.posexplode(_lines(F.col("text"))).alias("at", "line")).select(
        "row_key", "host", "at", F.xxhash64(_stripped(F.col("line"))).alias("line")
    )
    common = found(rows, ratio, least)
    drops = (
        lines.join(common.select(F.col("host").alias("site"), F.col("line").alias("common")),
                   lines.host.eqNullSafe(F.col("site")) & (F.col("line") == F.col("common")))
        .groupBy("row_key")
        .agg(F.collect_set("at").alias("drops"))
    )
    parts = _lines(F.col("text"))
    kept = F.filter(parts, lambda _, i: ~F.array_contains(F.col("drops"), i))
    return rows.join(drops, "row_key", "left").select(
        "doc",
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"),
        F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).alias("n_dropped"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the remaining text; a document's source is its host."""
    return without_boilerplate(docs, F.col("source")).select(
        F.col("doc.doc_id").alias("doc_id"),
        F.when(F.col("doc.text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        F.col("n_dropped").cast("long").alias("n_dropped"),
        F.col("kept_text").alias("text"),
    )


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents with their remaining text; ``n_chars`` follows it. Copies are one page."""
    rows = without_boilerplate(
        docs, F.col("source"), found=lambda *given: saved(boilerplate_of_groups(*given), "boilerplate")
    )
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(
            F.col("doc.n_chars")
        )
    return rows.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


ORACLE = f"""
WITH lines AS (
  SELECT rowid_, source, ord, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare
  FROM (
    SELECT rowid_, source, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS ord
    FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents) WHERE text IS NOT NULL
  )
), totals AS (
  SELECT source, count(*) AS host_pages FROM documents GROUP BY source
), common AS (
  SELECT c.source, c.bare FROM (
    SELECT source, bare, count(DISTINCT rowid_) AS line_pages FROM lines WHERE bare <> '' GROUP BY source, bare
  ) c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE line_pages >= {LEAST} AND line_pages::DOUBLE / host_pages > {RATIO}
), marked AS (
  SELECT l.rowid_, l.ord, l.line, c.bare IS NOT NULL AS gone
  FROM lines l LEFT JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.bare = c.bare
), made AS (
  SELECT rowid_, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY rowid_
)
SELECT d.doc_id, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_dropped, 0) AS n_dropped, m.text
FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents) d LEFT JOIN made m USING (rowid_)
"""
