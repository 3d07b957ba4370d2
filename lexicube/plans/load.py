"""Problem 2: rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexicube.session import new_path, table
from lexicube.sources.lines import parse_files, parse_lines, recover


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of ``emb_lines`` that give no vector, each with its first reason.

    By definition every line stands for itself here, so its end is sure and nothing has to
    be recovered; ``p2_recovered`` applies the rule that resumes behind open quotes.
    """
    return parse_lines(table(spark, folder, "emb_lines")).where("kind = 'error'").select("line_id", "reason")


def p2_recovered(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of every file that fail or are skipped, when an open quote swallows line ends."""
    out = recover(table(spark, folder, "emb_lines"))
    return out.where("kind in ('error', 'skipped')").select("file_name", "line_id", "kind", "reason")


def p2_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same for text files: lines by outcome, each file written in the order of its lines and read in blocks."""
    path = new_path(spark, "files")
    lines = table(spark, folder, "emb_lines").where("file_name is not null and raw_line is not null").select("file_name", "line_id", F.regexp_replace("raw_line", "[\\n\\r]", " ").alias("value"))
    lines.repartition("file_name").sortWithinPartitions("file_name", "line_id").select("value", F.regexp_replace("file_name", "[^A-Za-z0-9]", "_").alias("f")).write.partitionBy("f").text(path)
    name = F.regexp_extract("file_name", "f=([^/]+)/", 1)
    return parse_files(spark, path + "/*/*.txt").groupBy(name.alias("file"), "kind", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n_lines"))


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors that were loaded, as many rows as good lines."""
    return parse_lines(table(spark, folder, "emb_lines")).where("kind = 'record'").select("line_id", "doc_id", "embedding")


def p2_by_file(spark: SparkSession, folder: str) -> DataFrame:
    """Loaded, header and failed lines of every file, by reason."""
    out = parse_lines(table(spark, folder, "emb_lines"), keep=("line_id", "file_name"))
    return out.groupBy("file_name", "kind", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n_lines"))


QUERIES = {f.__name__: f for f in (p2_found, p2_recovered, p2_files, p2_loaded, p2_by_file)}

_NUMBER = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


def _outcomes(line: str, source: str) -> str:
    """Lines with their outcome, in SQL."""
    return rf"""raw AS (SELECT line_id, file_name, coalesce({line}, '') AS s FROM {source}),
f AS (SELECT *, list_filter(string_split_regex(s, '[ \t\r]+'), lambda x: x <> '') AS f FROM raw),
u AS (SELECT *, list_transform(f, lambda x: CASE WHEN regexp_full_match(x, '"[^"]*"') THEN x[2:-2] ELSE x END) AS v FROM f),
o AS (SELECT line_id, file_name, s, f, v, CASE WHEN len(f) = 2 AND len(list_filter(f, lambda x: regexp_full_match(x, '[0-9]+'))) = 2 THEN NULL
WHEN regexp_matches(s, '[\x{{FFFD}}\x00]') THEN 'encoding'
WHEN len(list_filter(f, lambda x: contains(x, '"') AND NOT regexp_full_match(x, '"[^"]*"'))) > 0 THEN 'quoting'
WHEN len(f) <> 101 THEN 'field_count'
WHEN NOT regexp_full_match(v[1], '[0-9]+') OR length(ltrim(v[1], '0')) > 19 OR try_cast(v[1] AS HUGEINT) > 9223372036854775807 THEN 'doc_id'
WHEN len(list_filter(v[2:], lambda x: NOT regexp_full_match(x, '{_NUMBER}') OR coalesce(abs(try_cast(x AS DOUBLE)) > 3.4028234663852886e38, true))) > 0 THEN 'value' END AS reason,
CASE WHEN len(f) = 2 AND len(list_filter(f, lambda x: regexp_full_match(x, '[0-9]+'))) = 2 THEN 'header' END AS header FROM u),
k AS (SELECT line_id, file_name, s, reason, coalesce(header, CASE WHEN reason IS NULL THEN 'record' ELSE 'error' END) AS kind FROM o)"""


_EVENTS = rf"""e AS (SELECT *, CASE WHEN (length(s) - length(replace(s, '"', ''))) % 2 = 1 THEN 1 WHEN regexp_matches(s, '^[ \t\r]*"?[^" \t\r\n]+"?[ \t\r]+"?{_NUMBER}"?([ \t\r\n]|$)') THEN 0 END AS ev FROM k),
r AS (SELECT file_name, line_id, CASE WHEN skipped THEN 'skipped' ELSE kind END AS kind, CASE WHEN skipped THEN 'quoting' ELSE reason END AS reason FROM (SELECT *, ev IS NULL AND coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY line_id ROWS UNBOUNDED PRECEDING) = 1, false) AS skipped FROM e))"""
_AS_FILES = "(SELECT line_id, regexp_replace(file_name, '[^A-Za-z0-9]', '_', 'g') AS file_name, regexp_replace(raw_line, '[\\n\\r]', ' ', 'g') AS raw_line FROM emb_lines WHERE file_name IS NOT NULL AND raw_line IS NOT NULL)"

ORACLE = {
    "p2_found": f"WITH {_outcomes('raw_line', 'emb_lines')} SELECT line_id, reason FROM k WHERE kind = 'error'",
    "p2_by_file": f"WITH {_outcomes('raw_line', 'emb_lines')} SELECT file_name, kind, coalesce(reason, 'none') AS reason, count(*) AS n_lines FROM k GROUP BY ALL",
    "p2_recovered": f"WITH {_outcomes('raw_line', 'emb_lines')}, {_EVENTS} SELECT file_name, line_id, kind, reason FROM r WHERE kind IN ('error', 'skipped')",
    "p2_files": f"WITH {_outcomes('raw_line', _AS_FILES)}, {_EVENTS} SELECT file_name AS file, kind, coalesce(reason, 'none') AS reason, count(*) AS n_lines FROM r GROUP BY ALL",
}
