"""Licence scan by canonical digests.

A text is brought to a canonical form (lower case, copyright lines dropped, equivalent
spellings made one, punctuation and white space collapsed), and its SHA-256 is looked up
among the digests of known licences. Whole documents are looked up, and each line as a text
of its own, since notices stand on lines. Equality of digests is the only test: no window,
no similarity.

The known digests are the fixed lists in licence_texts.py (a few dozen rows), hence the
broadcast; everything runs in the JVM without a shuffle. A caller's list of more than MOST
texts is joined without that hint. Of long licences (Apache, GPL, LGPL, MPL, GFDL, CC0) the
list holds digests alone, of the wording that their authors publish, line ends wherever
they stand, unless a line then begins with the word copyright.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import DIGESTS, LICENCES, NOTICES, SPELLINGS

#: A line that says who holds the copyright, on lower-case text.
COPYRIGHT = r"^[^a-z0-9]*(copyright\b|\(c\) ?[0-9]|© ?[0-9]|all rights reserved).*$"
PUNCTUATION = r"[^\p{L}\p{N}]+"
MOST = 100_000


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; empty for a copyright line or a line of punctuation."""
    out = F.regexp_replace(F.lower(line), COPYRIGHT, "")
    for pattern, by in SPELLINGS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(F.regexp_replace(out, PUNCTUATION, " "))


def _canonical_lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line)


def _whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def known_digests(spark: SparkSession, known: list[tuple[str, str]], digests: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(digest, license_id) of known texts and of given digests, one row a digest; of equal ones the smallest identifier stands."""
    table = spark.createDataFrame(known, "license_id string, text string")
    table = table.select("license_id", F.sha2(_whole(_canonical_lines(F.col("text"))), 256).alias("digest"))
    table = table.union(spark.createDataFrame(list(digests), "license_id string, digest string"))
    return table.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licences(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row (doc_id, scope, line, license_id, digest) per document or line that is a known licence text.

    scope is `document` (line -1: the whole text is the licence) or `line` (line counts from 0).
    Null and empty texts, and texts that are all punctuation, match nothing. Equal rows of docs
    give equal rows of the result; other columns of docs are left out. An empty table gives an
    empty one. `known` takes the place of the built-in lists; an empty one finds nothing.
    """
    lines = docs.select("doc_id", _canonical_lines(F.col("text")).alias("lines"))
    units = F.concat(
        F.array(F.struct(F.lit("document").alias("scope"), F.lit(-1).alias("line"), _whole(F.col("lines")).alias("canonical"))),
        F.transform("lines", lambda x, i: F.struct(F.lit("line").alias("scope"), i.alias("line"), x.alias("canonical"))),
    )
    rows = lines.select("doc_id", F.inline(F.filter(units, lambda u: u["canonical"] != "")))
    rows = rows.select("doc_id", "scope", "line", F.sha2("canonical", 256).alias("digest"))
    table = known_digests(docs.sparkSession, LICENCES + NOTICES if known is None else known, DIGESTS if known is None else [])
    return rows.join(F.broadcast(table) if known is None or len(known) <= MOST else table, "digest").select("doc_id", "scope", "line", "license_id", "digest")


def scan_sql(known: list[tuple[str, str]] | None = None) -> str:
    """The same for DuckDB."""
    def canonical(x: str) -> str:
        out = f"regexp_replace(lower({x}), '{COPYRIGHT}', '', 'g')"
        for pattern, by in SPELLINGS:
            out = f"regexp_replace({out}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
        return f"trim(regexp_replace({out}, '{PUNCTUATION}', ' ', 'g'), ' ')"

    lines = f"list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {canonical('x')})"
    whole = "array_to_string(list_filter(lines, lambda x: x <> ''), ' ')"
    values = ", ".join(f"('{i}', '{t.replace(chr(39), chr(39) * 2)}')" for i, t in (LICENCES + NOTICES if known is None else known))
    given = "".join(f" UNION ALL SELECT '{d}', '{i}'" for i, d in (DIGESTS if known is None else []))
    return f"""
    WITH known_texts(license_id, text) AS (VALUES {values}),
    known_lines AS (SELECT license_id, {lines} AS lines FROM known_texts),
    known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT sha256({whole}) AS digest, license_id FROM known_lines{given}) GROUP BY 1),
    doc_lines AS (SELECT doc_id, {lines} AS lines FROM documents),
    units AS (
      SELECT doc_id, 'document' AS scope, -1 AS line, {whole} AS canonical FROM doc_lines
      UNION ALL
      SELECT doc_id, 'line', CAST(generate_subscripts(lines, 1) - 1 AS INTEGER), unnest(lines) FROM doc_lines)
    SELECT doc_id, scope, line, license_id, digest
    FROM (SELECT doc_id, scope, line, sha256(canonical) AS digest FROM units WHERE canonical <> '') JOIN known USING (digest)"""
