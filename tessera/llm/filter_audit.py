"""How filters share what they remove: Shapley values from the multilinear extension of removal.

A document fails a set of filters, its mask. Per part of the corpus, the documents are counted by mask: at most 32 numbers for five
filters. The part's removal polynomial gives, for x_i in [0, 1] (filter i is applied with probability x_i), the
expected number of documents removed: a document of mask M is removed with 1 - prod over M of (1 - x_i), which
multiplies out to a sum of monomials, one for each non-empty subset T of M, with sign (-1)**(|T|+1). Hence the coefficient of T is that sign
times the number of documents whose mask contains T.

* At a corner of the cube (x = 1 on a set S, 0 elsewhere) the polynomial counts what the filters of S remove together; what is
  left survives. Every order of the filters walks along corners.
* The integral of the partial derivative by x_i along the diagonal is filter i's Shapley value: each monomial T that holds i gives its
  coefficient over |T|. Denominators are 1 to 5 and divide 120 = 5!, so that 120 times the value, the sum over all orders, is an
  exact whole number.

Counting the documents is the only work that grows with the corpus: texts are read once, for their mask and a
digest; whether a text stands in a smaller doc_id is found by counting (digest, mask, part, doc_id) and then a digest's least
doc_id; groups of copies are combined before they are shuffled. The polynomial is a table of at most 32 rows a part.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: What parts words, and the failure conditions' patterns.
SPACE, CAPITALS, SIGNS = r"[\x20\x09-\x0D]+", "[A-Z]", "[#$%&*|]"
FILTERS = "ABCDE"
#: The filter that a text fails if a smaller doc_id has it: known only from the whole table.
REPEATED = FILTERS.index("E")
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_mask(text: Column) -> tuple[dict[str, Column], Column]:
    """Columns to add first, and the bits of the filters A to D that a text fails."""
    words = {"_words": F.array_remove(F.split(text, SPACE), "")}
    n, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    fails = (n < 200, 100 * distinct < 50 * n, 100 * F.regexp_count(text, F.lit(CAPITALS)) > 2 * F.length(text), text.rlike(SIGNS))
    mask = F.lit(0)
    for bit, failed in enumerate(fails):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return words, mask


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words, mask = text_mask(F.col("text"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumns(words)
    rows = written(source.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask")), "masks")

    # A label counts if any row of its doc_id says so. Only labelled documents meet this join; a null doc_id has no label.
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))))
    marked = rows.join(marks.where("good + toxic > 0"), "doc_id").select("doc_id", "part", "digest", "mask", F.lit(0).alias("n"), "good", "toxic")
    every = rows.select("doc_id", "part", "digest", "mask", F.lit(1).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic")).unionByName(marked)

    sums = lambda prefix="": [F.sum(f"{prefix}{c}").alias(c) for c in ("n", "good", "toxic")]
    each = every.groupBy("digest", "part", "mask", "doc_id").agg(*sums())
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "good", "toxic"))).alias("first")
    unnumbered = [F.sum(F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(0)).alias(f"{c}_null") for c in ("n", "good", "toxic")]
    grouped = written(each.groupBy("digest", "part", "mask").agg(*sums(), first, *unnumbered), "copies")
    least = grouped.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    placed = grouped.join(least, "digest")
    # Rows of the least doc_id pass filter E, and so do rows without an id, which no id is smaller than.
    passing = [(F.when(F.col("first.doc_id") == F.col("least"), F.col(f"first.{c}")).otherwise(0) + F.col(f"{c}_null")).alias(c) for c in ("n", "good", "toxic")]
    both = placed.select("part", "mask", *(F.col(c).alias(f"{c}_all") for c in ("n", "good", "toxic")), *passing)
    cases = F.array(F.struct("mask", "n", "good", "toxic"), F.struct((F.col("mask") + (1 << REPEATED)).alias("mask"), *((F.col(f"{c}_all") - F.col(c)).alias(c) for c in ("n", "good", "toxic"))))
    return both.select("part", F.inline(cases)).groupBy("part", "mask").agg(*sums())


def _sets(filters: int, test: Callable[[Column], Column]) -> Column:
    """The sets of filters, as bits, that pass the test."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit((1 << filters) - 1)), test))


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def removal_polynomial(counts: DataFrame, filters: int) -> DataFrame:
    """(part, t, n, good, toxic): the coefficient of each monomial t (a set of filters) that isn't 0 for want of documents; at t = 0 stand
    the part's documents themselves."""
    held = counts.select("part", _sets(filters, lambda t: t.bitwiseAND(F.col("mask")) == t).alias("t"), "n", "good", "toxic")
    sign = F.when((F.bit_count("t") % 2 == 1) | (F.col("t") == 0), 1).otherwise(-1)
    return _sums(held, "part", "t").select("part", "t", *((sign * F.col(c)).alias(c) for c in ("n", "good", "toxic")))


def corners(poly: DataFrame, filters: int) -> DataFrame:
    """(part, s, n, good, toxic): the polynomial at x = 1 on the set s, 0 elsewhere: what the filters of s remove together."""
    return _sums(poly.where("t > 0").select("part", _sets(filters, lambda s: s.bitwiseAND(F.col("t")) == F.col("t")).alias("s"), "n", "good", "toxic"), "part", "s")


def scaled_shapley(poly: DataFrame, filters: int) -> DataFrame:
    """(part, i, value): factorial(filters) times the integral of the derivative by x_i along the diagonal; a whole number."""
    inside = F.explode(F.filter(F.sequence(F.lit(0), F.lit(filters - 1)), lambda i: F.call_function("shiftright", F.col("t"), i).bitwiseAND(F.lit(1)) == 1))
    terms = poly.where("t > 0").select("part", inside.alias("i"), (F.col("n") * F.expr(f"{factorial(filters)} div bit_count(t)")).alias("value"))
    return terms.groupBy("part", "i").agg(F.sum("value").alias("value"))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, COUNTS) for every order of the filters, from mask_counts(); meant for up to five filters.

    A part without documents has no row; an empty table gives an empty one.
    """
    k = len(filters)
    poly = written(removal_polynomial(counts, k), "polynomial")  # at most 2 ** k rows a part
    long = corners(poly, k).select("part", F.struct("s", F.struct("n", "good", "toxic").alias("x")).alias("corner"), F.lit(None).cast("struct<i:int,value:long>").alias("value"), F.lit(0).cast("long").alias("n"))
    long = long.unionByName(scaled_shapley(poly, k).select("part", F.struct("i", "value").alias("value"), F.lit(0).cast("long").alias("n")), allowMissingColumns=True)
    long = long.unionByName(poly.where("t = 0").select("part", "n"), allowMissingColumns=True)
    parts = long.groupBy("part").agg(F.map_from_entries(F.collect_list("corner")).alias("corners"), F.map_from_entries(F.collect_list("value")).alias("values"), F.sum("n").alias("n"))

    steps = [("".join(filters[i] for i in order), at + 1, sum(1 << i for i in order[:at]), order[at]) for order in permutations(range(k)) for at in range(k)]
    plan = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{s},"before":{b},"i":{i}}}' for o, s, b, i in steps) + "]"), "array<struct<filter_order:string,step:int,before:int,i:int>>")
    rows = parts.select("*", F.inline(plan)).withColumn("bit", F.call_function("shiftleft", F.lit(1), F.col("i"))).withColumn("after", F.col("before") + F.col("bit"))
    at = lambda c, s: F.coalesce(F.try_element_at("corners", s)[c], F.lit(0))
    gone, full = at("n", F.col("after")) - at("n", F.col("before")), F.lit((1 << k) - 1)
    return rows.select(
        "part", "filter_order", "step", (F.col("n") - at("n", F.col("after"))).alias("kept"), gone.alias("removed"), (at("n", F.col("bit")) - gone).alias("redundant"),
        (at("n", full) - at("n", full - F.col("bit"))).alias("unique_fails"), *((at(c, F.col("after")) - at(c, F.col("before"))).alias(f"{c}_lost") for c in ("good", "toxic")), F.coalesce(F.try_element_at("values", F.col("i")), F.lit(0)).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit() of the five filters on docs, per source.

    A null text is empty, a null source the empty string. A null doc_id is identical to no smaller one and has no label; rows that share
    doc_id and text do not fail E by one another. Null labels count as 0. Other columns are left out; empty documents give an empty table.
    """
    return audit(mask_counts(docs, labels))


def audit_sql() -> str:
    """filter_interactions for DuckDB, each order walked step by step."""
    picks = ", ".join(f"f{i}.i AS i{i}" for i in range(5))
    apart = " AND ".join(f"f{i}.i <> f{j}.i" for i in range(5) for j in range(i))
    order = " || ".join(f"substr('{FILTERS}', i{i} + 1, 1)" for i in range(5))
    steps = " UNION ALL ".join(f"SELECT {order} AS filter_order, {s + 1} AS step, i{s} AS i, CAST({' + '.join(['0', *(f'(1 << i{j})' for j in range(s))])} AS INTEGER) AS before FROM orders" for s in range(5))
    return rf"""
    WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    split AS (SELECT *, [w FOR w IN string_split_regex(text, '{SPACE}') IF w <> ''] AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
    marked AS (SELECT doc_id, part, CAST(len(words) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER)
        + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INTEGER) + 8 * CAST(regexp_matches(text, '{SIGNS}') AS INTEGER) + 16 * CAST(coalesce(doc_id > least, false) AS INTEGER) AS mask FROM split),
    named AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY ALL),
    counts AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM marked LEFT JOIN named USING (doc_id) GROUP BY ALL),
    f AS (SELECT unnest(range(0, 5)) AS i),
    orders AS (SELECT {picks} FROM f f0, f f1, f f2, f f3, f f4 WHERE {apart}),
    steps AS ({steps}),
    walked AS (SELECT part, filter_order, step, i,
        coalesce(sum(n) FILTER ((mask & (before | (1 << i))) = 0), 0) AS kept, coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask >> i) & 1 = 1), 0) AS removed,
        coalesce(sum(n) FILTER ((mask & before) <> 0 AND (mask >> i) & 1 = 1), 0) AS redundant, coalesce(sum(n) FILTER (mask = (1 << i)), 0) AS unique_fails,
        coalesce(sum(good) FILTER ((mask & before) = 0 AND (mask >> i) & 1 = 1), 0) AS good_lost, coalesce(sum(toxic) FILTER ((mask & before) = 0 AND (mask >> i) & 1 = 1), 0) AS toxic_lost
        FROM counts, steps GROUP BY ALL),
    shared AS (SELECT part, i, sum(removed) AS shapley FROM walked GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in COUNTS)} FROM walked JOIN shared USING (part, i)"""
