"""Quality rules whose thresholds come from the corpus: quantile sketches per language and source.

Per document four ratios are taken (whole numbers, thousandths): characters per word, symbols per word character, lines that repeat
an earlier line, words in repeated windows. A group's sketch of a ratio is a histogram over buckets of bounded relative
width: values up to 63 stand alone, larger ones share a bucket with those that agree in their six leading bits, so that a
bucket is at most 1/32 of its values wide. Sketches merge by adding counts: tasks merge into a (language, source) group, groups into a
language, languages into all. What a sketch holds is bounded by the number of buckets, not by the rows, and the result does not
depend on the order of merging.

A rule's threshold is a quartile moved outwards by `reach` times the distance of quartile and median, or by `reach` times a
floor where the group hardly varies. Groups of fewer than `least` documents take the language's thresholds, and those of small
languages the thresholds of all. The thresholds, one row a group, are joined to the documents' ratios; how is left to the planner, which
knows their size.

All of it is DataFrame functions. Ratios are computed once per text and written; sketch and filter read those few numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import set_aside, written

#: What parts words, and the signs that count as symbols.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
MIN_WORDS, MAX_REPEATED, WINDOW = 50, 50, 3
LEAST, REACH = 100, 4
#: Leading bits that a bucket keeps.
BITS = 6
FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A ratio `part` / `whole` in thousandths, and the least spread per side; a floor of None leaves that side open."""

    name: str
    part: str
    whole: str
    below: int | None
    above: int | None


RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 250),
    Rule("symbols", "n_symbols", "word_chars", None, 10),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 80),
    Rule("repeats", "n_repeat_words", "n_words", None, 60),
)


def _repeated_words(words: Column, window: int = WINDOW) -> tuple[list[dict[str, Column]], Column]:
    """Steps that add columns, and the number of words that lie in a window which the text has twice or more.

    No lambda reads a column from outside, so that nothing is computed again per element.
    """
    pair = lambda x: F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("a"), F.slice(x, 2, F.size(x) - 1).alias("b"))
    parts = [F.slice("_hashes", k + 1, F.greatest(F.size("_hashes") - (window - 1), F.lit(0))).alias(f"w{k}") for k in range(window)]
    steps = [
        {"_hashes": F.transform(words, lambda w: F.xxhash64(w))},
        {"_windows": F.transform(F.arrays_zip(*parts), lambda t: F.xxhash64(*(t[f"w{k}"] for k in range(window))))},
        # Windows in the order of their hashes; only where some are equal.
        {"_sorted": F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))},
        {"_equal": F.filter(pair(F.col("_sorted")), lambda p: p["a"]["h"] == p["b"]["h"])},
        {"_at": F.sort_array(F.array_union(F.transform("_equal", lambda p: p["a"]["i"]), F.transform("_equal", lambda p: p["b"]["i"])))},
        {"_gaps": F.transform(pair(F.col("_at")), lambda p: F.least(F.lit(window), p["b"] - p["a"]))},
    ]
    return steps, F.coalesce(F.aggregate("_gaps", F.lit(window), lambda total, gap: total + gap), F.lit(0)).cast("long")


def with_facts(df: DataFrame) -> DataFrame:
    """df (with a column text) and the counts of FACTS, n_lines and base_failed; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACE))
    out = df.withColumns({"_words": F.array_remove(F.split(text, SPACE), ""), "_lines": lines, "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long")})
    steps, repeated = _repeated_words(F.col("_words"))
    for columns in steps:
        out = out.withColumns(columns)
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"), "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "n_repeat_words": repeated,
    })
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    return out.drop("_words", "_lines", "_hashes", "_windows", "_sorted", "_equal", "_at", "_gaps")


def ratio(rule: Rule) -> Column:
    """Thousandths, rounded down; null where there is nothing to divide by."""
    return F.when(F.col(rule.whole) > 0, F.floor(1000 * F.col(rule.part) / F.col(rule.whole)))


def bucket(value: Column) -> Column:
    """The least value of the value's bucket."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return value - F.pmod(value, F.call_function("shiftleft", F.lit(1).cast("long"), shift))


def sketches(facts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(level, lang, source, rule, bucket, n): level 0 per language and source, 1 per language, 2 of all."""
    values = F.array(*(F.struct(F.lit(r.name).alias("rule"), bucket(ratio(r)).alias("bucket")) for r in rules))
    own = facts.select("lang", "source", F.inline(values)).where("bucket is not null").groupBy("lang", "source", "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.inline(_levels()), "rule", "bucket", "n").groupBy("level", "lang", "source", "rule", "bucket").agg(F.sum("n").alias("n"))


def _levels() -> Column:
    none = F.lit(None).cast("string")
    return F.array(*(F.struct(F.lit(i).alias("level"), lang.alias("lang"), source.alias("source")) for i, (lang, source) in enumerate(((F.col("lang"), F.col("source")), (F.col("lang"), none), (none, none)))))


def quartiles(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, rule, n, q25, q50, q75) of each sketch: the bucket that holds the smallest value with that share at or below it."""
    keys = ["level", "lang", "source", "rule"]
    counts = F.array_sort(F.collect_list(F.struct("bucket", "n")))  # a sketch: as many rows as there are buckets
    summed = sketch.groupBy(*keys).agg(F.sum("n").alias("n"), counts.alias("counts"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), *(F.lit(None).cast("long").alias(f"q{q}") for q in (25, 50, 75)))

    def step(total: Column) -> Callable[[Column, Column], Column]:
        def run(state: Column, row: Column) -> Column:
            so_far = state["sum"] + row["n"]
            reached = (F.coalesce(state[f"q{q}"], F.when(100 * so_far >= q * total, row["bucket"])).alias(f"q{q}") for q in (25, 50, 75))
            return F.struct(so_far.alias("sum"), *reached)

        return run

    return summed.withColumn("_q", F.aggregate("counts", start, step(F.col("n")))).select(*keys, "n", "_q.q25", "_q.q50", "_q.q75")


def thresholds(facts: DataFrame, rules: tuple[Rule, ...] = RULES, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """(lang, source, level, <rule>_from, <rule>_to): one row for each pair of language and source that the facts have.

    `level` tells whose thresholds they are: 0 the group's own, 1 the language's, 2 those of all documents.
    """
    found = quartiles(sketches(facts, rules))
    bounds = []
    for r in rules:
        q = {k: F.max(F.when(F.col("rule") == r.name, F.col(k))) for k in ("q25", "q50", "q75")}
        low = q["q25"] - reach * F.greatest(q["q50"] - q["q25"], F.lit(r.below)) if r.below is not None else F.lit(None)
        high = q["q75"] + reach * F.greatest(q["q75"] - q["q50"], F.lit(r.above)) if r.above is not None else F.lit(None)
        bounds += [low.cast("long").alias(f"{r.name}_from"), high.cast("long").alias(f"{r.name}_to")]
    own = found.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *bounds)
    names = [c for c in own.columns if c not in ("level", "lang", "source", "n")]
    wanted = found.where("level = 0").select("lang", "source").distinct().select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.inline(_levels())).withColumnsRenamed({c: f"_at_{c}" for c in ("level", "lang", "source")})
    fit = wanted.join(own, [F.col(f"_at_{c}").eqNullSafe(F.col(c)) for c in ("level", "lang", "source")]).where((F.col("n") >= least) | (F.col("level") == 2))
    best = fit.groupBy("_lang", "_source").agg(F.min(F.struct("level", *names)).alias("_b"))
    return best.select("_lang", "_source", "_b.*")


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """True if every ratio lies within its group's thresholds; a ratio that a text doesn't have passes."""
    sides = [F.coalesce(side, F.lit(True)) for r in rules for side in (ratio(r) >= F.col(f"{r.name}_from"), ratio(r) <= F.col(f"{r.name}_to"))]
    out = F.lit(True)
    for side in sides:
        out = out & side
    return out


def _judged(facts: DataFrame, limits: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    joined = facts.join(limits, facts["lang"].eqNullSafe(limits["_lang"]) & facts["source"].eqNullSafe(limits["_source"]), "left").drop("_lang", "_source")
    return joined.withColumn("kept", ~F.col("base_failed") & passes(rules))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """Per row of docs: doc_id, lang, source, the counts of FACTS and n_lines, base_failed, level, the thresholds and kept.

    Null and empty texts have counts of 0, fail the base rules and are not kept. A null language or source is a group of its own. Repeated
    rows are judged row by row, alike. All documents count in the sketches, but for ratios that a text without
    words or lines doesn't have. Other columns are left out; an empty table gives an empty one.
    """
    source = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    facts = written(with_facts(source).drop("text"), "facts")
    return _judged(facts, thresholds(facts, rules, least, reach), rules)


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """docs without the rows that judged() does not keep; all columns stay, whatever their names."""
    plain, back = set_aside(docs)
    at = {name: plain.columns[i] for i, name in enumerate(docs.columns)}
    full = with_facts(plain.withColumns({c: F.col(at[c]).cast("string") for c in ("lang", "source")}))
    facts = written(full.select("lang", "source", *FACTS, "n_lines", "base_failed"), "facts")
    return back(_judged(full, thresholds(facts, rules, least, reach), rules).where("kept"))


def rules_sql(rules: tuple[Rule, ...] = RULES, least: int = LEAST, reach: int = REACH) -> str:
    """The report of the query (doc_id, FACTS, base_failed, kept) for DuckDB, on a table whose doc_id is unique."""
    value = lambda r: f"CASE WHEN {r.whole} > 0 THEN 1000 * {r.part} // {r.whole} END"
    values = " UNION ALL ".join(f"SELECT lang, source, '{r.name}' AS rule, {value(r)} AS v FROM facts WHERE {r.whole} > 0" for r in rules)
    q = lambda r, k: f"max(q{k}) FILTER (rule = '{r.name}')"
    bounds = ", ".join(
        [f"{q(r, 25)} - {reach} * greatest({q(r, 50)} - {q(r, 25)}, {r.below}) AS {r.name}_from" for r in rules if r.below is not None]
        + [f"{q(r, 75)} + {reach} * greatest({q(r, 75)} - {q(r, 50)}, {r.above}) AS {r.name}_to" for r in rules if r.above is not None]
    )
    tests = " AND ".join([f"coalesce({value(r)} >= {r.name}_from, true)" for r in rules if r.below is not None] + [f"coalesce({value(r)} <= {r.name}_to, true)" for r in rules if r.above is not None])
    return rf"""
    WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    split AS (SELECT *, [w FOR w IN string_split_regex(text, '{SPACE}') IF w <> ''] AS words, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{NOT_SPACE}')] AS rows FROM texts),
    windows AS (SELECT doc_id, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM split),
    keyed AS (SELECT doc_id, i, words[i:i + {WINDOW - 1}] AS w FROM windows),
    often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM keyed),
    covered AS (SELECT DISTINCT doc_id, i + unnest(range(0, {WINDOW})) AS word FROM often WHERE n > 1),
    repeated AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY ALL),
    facts AS (SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(w) FOR w IN words]), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(rows) - len(list_distinct(rows)) AS BIGINT) AS n_dup_lines,
        CAST(len(rows) AS BIGINT) AS n_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM split LEFT JOIN repeated USING (doc_id)),
    vals AS ({values}),
    cells AS (SELECT lang, source, rule, v - v % (1::BIGINT << greatest(length(bin(v)) - {BITS}, 0)) AS cell FROM vals),
    leveled AS (SELECT 0 AS level, lang, source, rule, cell FROM cells UNION ALL SELECT 1, lang, NULL, rule, cell FROM cells UNION ALL SELECT 2, NULL, NULL, rule, cell FROM cells),
    counts AS (SELECT level, lang, source, rule, cell, count(*) AS n FROM leveled GROUP BY ALL),
    sums AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY cell) AS so_far, sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM counts),
    quartiles AS (SELECT level, lang, source, rule, max(total) AS n, min(cell) FILTER (100 * so_far >= 25 * total) AS q25, min(cell) FILTER (100 * so_far >= 50 * total) AS q50, min(cell) FILTER (100 * so_far >= 75 * total) AS q75 FROM sums GROUP BY ALL),
    bounds AS (SELECT level, lang, source, max(n) AS n, {bounds} FROM quartiles GROUP BY ALL),
    fit AS (SELECT g.lang AS own_lang, g.source AS own_source, b.* FROM (SELECT DISTINCT lang, source FROM facts) g JOIN bounds b ON (b.level = 2 OR b.lang IS NOT DISTINCT FROM g.lang) AND (b.level > 0 OR b.source IS NOT DISTINCT FROM g.source) WHERE b.n >= {least} OR b.level = 2),
    best AS (SELECT * EXCLUDE (lang, source, n) FROM fit QUALIFY row_number() OVER (PARTITION BY own_lang, own_source ORDER BY level) = 1),
    based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM facts)
    SELECT doc_id, {', '.join(FACTS)}, base_failed, NOT base_failed AND {tests} AS kept
    FROM based LEFT JOIN best ON own_lang IS NOT DISTINCT FROM lang AND own_source IS NOT DISTINCT FROM source"""
