"""Benchmark decontamination by question templates.

A text becomes a template: numbers (in digits or words), units after numbers, and names (words with a capital) give way to typed
placeholders, neighbouring numbers and neighbouring names to one (`New York`, `twenty five`, `1 200`); a unit is parted from its
number (`5kg`); the rest goes to lower case without punctuation. Runs of `width` template words of the documents are hash-joined
to those of the benchmark and compared as words. An item has the runs of its lower-case text besides, so that names which a
document writes small are met as plain words. Matching runs of one document and item at one shift, or at shifts that differ by a few
words, are taken together; what fills the slots on either side must then be consistent: an item's value may be replaced, but by the
same value everywhere. So a copy is found (no slot changed), and so is a question with other numbers and names.

All of it is SQL functions. Before the join, a table of at most `max_cells` cells, seven to a byte, that marks the hashes of the
benchmark's runs by two cells each (false marks possible, missed ones not) sorts out nearly all runs of the documents while
they are still array elements, so that only runs that may match become rows, and only texts with such runs are cut into their own words. How the few rows that remain are
joined to the benchmark is left to the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import set_aside, written

WIDTH, LEAST, RUNS = 8, 4, 6
#: Cells of the table that marks the hashes of the benchmark's runs. Plans hold the table, and Spark's driver writes plans out as text again and again.
MAX_CELLS = 1 << 22
#: Cells of a byte: a byte below 128 is a character of its own, so that `ascii` gives its number.
PER_BYTE = 7
#: Shifts that differ by less than half of this are met together in one group.
NEAR = 16
#: Number words and units that count as such.
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion"
UNITS = "mm|cm|m|km|miles?|met(?:er|re)s?|feet|foot|inch(?:es)?|mg|g|kg|grams?|kilograms?|tons?|tonnes?|pounds?|lbs?|oz|ounces?|ml|l|lit(?:er|re)s?|s|seconds?|minutes?|mins?|h|hours?|hrs?|days?|weeks?|months?|years?|dollars?|cents?|euros?|usd|eur|percent|degrees?|kmh|mph"
#: (pattern, replacement), in this order, on a text between spaces; without a group the pattern is plain text. Written so that Java's
#: expressions and RE2 read them alike. Two spaces part words, so that every word has one on either side of its own.
MARKS = [
    (r"[\x20\x09-\x0D]+", "  "),
    (r"[<>{}\[\]_]+", "-"),
    (r" [^\p{L}\p{N} ]+ ", ""),  # signs alone
    (rf"([0-9])(?i:({UNITS}))([^\p{{L}}\p{{N}}])", "$1  $2$3"),
    (r"([0-9]+(?:[.,:/][0-9]+)*)", "<n$1>"),
    (rf" (?i:((?:{NUMBER_WORDS})(?:-(?:{NUMBER_WORDS}))*))([^\p{{L}}\p{{N}} ]* )", " <n$1>$2"),
    (">  <n", "_"),
    (rf">  (?i:({UNITS}))([^\p{{L}}\p{{N}} ]* )", ">  <u$1}$2"),
    (r" ([^\p{L}\p{N} <]*)(\p{Lu}[\p{L}\p{M}]*(?:-\p{Lu}[\p{L}\p{M}]*)*)", " $1<p$2]"),
    ("]  <p", "_"),
]
#: From the marked text to the template.
BARE = [(r"<([nup])[^>}\]]*[>}\]]", "<$1>"), (r"[^\p{L}\p{N}<> ]+", "")]


def _by_first(words: str) -> tuple[str, str]:
    """Plain words as alternatives of their first letters, and those letters in both cases."""
    rest: dict[str, list[str]] = {}
    for word in words.split("|"):
        rest.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{c}(?:{'|'.join(ends)})" for c, ends in rest.items()), "".join(c + c.upper() for c in rest)


_NUMBERS, _FIRST = _by_first(NUMBER_WORDS)
#: Patterns that match the same, written so that Java's expressions, which try alternatives and classes one by one, give up a plain word at its first letter.
QUICK = {
    MARKS[5][0]: rf" (?=[{_FIRST}])(?i:((?:{_NUMBERS})(?:-(?:{_NUMBERS}))*))([^\p{{L}}\p{{N}} ]* )",
    MARKS[8][0]: r" (?![a-z ])([^\p{L}\p{N} <]*)(\p{Lu}[\p{L}\p{M}]*(?:-\p{Lu}[\p{L}\p{M}]*)*)",
    BARE[1][0]: r"[^\p{L}\p{N}<> a-z]+",
}


def _steps(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        plain = by == "_"
        text = F.replace(text, F.lit(pattern), F.lit(by)) if plain else F.regexp_replace(text, QUICK.get(pattern, pattern), by)
    return text


def template(marked: Column) -> Column:
    """A marked text's words with typed placeholders, in lower case, without punctuation."""
    return F.split(F.trim(F.lower(_steps(marked, BARE))), "  ")


def _marked(df: DataFrame, *keys: str) -> DataFrame:
    """Marked texts and their template words."""
    marked = df.select(*keys, _steps(F.concat(F.lit(" "), F.coalesce(F.col("text"), F.lit("")), F.lit(" ")), MARKS).alias("marked"))
    return marked.select(*keys, "marked", template(F.col("marked")).alias("canon"))


def _raw() -> Column:
    """A marked text's words, one to one with the template's; a placeholder's word holds all words that it stands for."""
    return F.split(F.trim("marked"), "  ")


def cells_of(hash: Column, size: int) -> list[Column]:
    """The two cells of a run's hash, as byte and bit, in a table of `size` bytes (a power of two)."""
    at = lambda byte, bit: F.struct(F.pmod(byte, F.lit(size)).cast("int").alias("byte"), F.pmod(bit, F.lit(PER_BYTE)).cast("int").alias("bit"))
    return [at(hash, F.shiftright(hash, 44)), at(F.shiftright(hash, 24), F.shiftright(hash, 54))]


def marked_cells(hashes: DataFrame, size: int) -> bytes:
    """The table: 1 at both cells of each hash."""
    marks = bytearray(size)
    for byte, bit in hashes.select(F.explode(F.array(*cells_of(F.col("hash"), size))).alias("cell")).select("cell.*").distinct().collect():  # PER_BYTE * `size` rows at most
        marks[byte] |= 1 << bit
    return bytes(marks)


def may_be_met(hash: Column, size: int, marks: bytes) -> Column:
    """Whether the table has both cells of a hash."""
    first, second = (F.getbit(F.ascii(F.substring(F.lit(marks), cell["byte"] + 1, 1).cast("string")), cell["bit"]) == 1 for cell in cells_of(hash, size))
    return first & second


def _spots(rows: DataFrame, width: int, size: int, marks: bytes) -> DataFrame:
    """The runs of `width` template words that may be met, with their words; words are cut for those only."""
    last = F.size("canon") - width + 1
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice("canon", i, width)).alias("hash")))
    met = rows.withColumn("met", F.filter(runs, lambda r: may_be_met(r["hash"], size, marks)))  # no where(): the planner would compute all of it twice
    met = met.select("doc_id", "version", "met", "canon", F.when(F.size("met") > 0, _raw()).alias("raw"))
    cut = F.transform("met", lambda r: F.struct(r["pos"].alias("pos"), r["hash"].alias("hash"), F.slice("raw", r["pos"], width).alias("doc_raw"), F.slice("canon", r["pos"], width).alias("doc_canon")))
    return met.select("doc_id", "version", F.explode(cut).alias("_run")).select("doc_id", "version", "_run.*")


def benchmark_runs(benchmark: DataFrame, width: int, least: int) -> DataFrame:
    """(item_id, item, width, at, runs, hash, item_raw, item_canon) of the items' runs and of those of their lower-case texts.

    An item of fewer words is one run of its own width; one of fewer than `least` words has none. `runs` is their number in the
    text as it stands. Copies of a row count once; an item_id that stands over several texts has the runs of each.
    """
    rows = benchmark.select("item_id", "text").dropDuplicates().withColumn("item", F.xxhash64("text"))
    both = rows.select("item_id", "item", F.lit(0).alias("small"), "text").union(rows.select("item_id", "item", F.lit(1), F.lower("text")))
    items = _marked(both, "item_id", "item", "small").withColumn("raw", _raw()).where(F.size("canon") >= least)
    items = items.withColumn("width", F.least(F.lit(width), F.size("canon"))).withColumn("runs", F.size("canon") - F.col("width") + 1)
    rows = items.select("item_id", "item", "small", "width", "runs", "raw", "canon", F.explode(F.sequence(F.lit(1), F.col("runs"))).alias("at"))
    cut = lambda c: F.expr(f"slice({c}, at, width)")
    rows = rows.select("item_id", "item", "small", "width", "at", "runs", F.xxhash64(cut("canon")).alias("hash"), cut("raw").alias("item_raw"), cut("canon").alias("item_canon"))
    rows = rows.groupBy("item_id", "item", "width", "at", "hash", "item_canon").agg(F.min_by("item_raw", "small").alias("item_raw"))
    own = items.groupBy("item_id", "item").agg(F.min_by("runs", "small").alias("runs"))
    return rows.join(own, ["item_id", "item"]).select("item_id", "item", "width", "at", "runs", "hash", "item_raw", "item_canon")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: int = LEAST, runs: int = RUNS, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per document and item: doc_id, version, item_id, n_runs, item_runs, n_slots, n_changed.

    A pair is reported if at one shift, or at shifts near one another, `runs` of the item's runs match (all, if it has fewer), and
    every slot value of the item is replaced by one value only. n_slots counts the item's distinct slot values, n_changed
    those that differ in the document: 0 for a copy. version is a hash of the text. Null and empty texts match
    nothing. Rows equal in doc_id and text count as one document; a null doc_id is a value like any other.
    Columns other than doc_id, item_id and text are left out; empty tables give an empty one.
    """
    items = written(benchmark_runs(benchmark, width, least), "benchmark-runs")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.collect_set("width").alias("widths")).first()  # `width` widths at most
    table = max(1, min(max_cells, 1 << (32 * size.n + 1024).bit_length()) // 8)  # bytes: a power of two
    rows = _marked(docs.select("doc_id", F.xxhash64("text").alias("version"), "text"), "doc_id", "version")
    found = None
    for w in sorted(size.widths) or [width]:
        own = items.where(F.col("width") == w)
        spots = _spots(rows, w, table, marked_cells(own, table))
        hits = spots.join(own, (spots["hash"] == own["hash"]) & (spots["doc_canon"] == own["item_canon"]))
        hits = hits.select("doc_id", "version", "item_id", "item", "at", "runs", (F.col("pos") - F.col("at")).alias("shift"), "item_raw", "item_canon", "doc_raw")
        found = hits if found is None else found.unionByName(hits)
    bare = lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")
    filled = F.zip_with(F.arrays_zip("item_raw", "doc_raw"), "item_canon", lambda v, c: F.when(c.contains("<"), F.struct(bare(v["item_raw"]).alias("item_value"), bare(v["doc_raw"]).alias("doc_value"))))
    # A run stands in three groups: that of its shift, and those of two overlapping ranges of shifts.
    half = lambda x: F.floor((F.col("shift") + x) / NEAR)
    places = F.array(*(F.struct(F.lit(i).alias("kind"), p.cast("long").alias("number")) for i, p in enumerate((F.col("shift"), half(0), half(NEAR // 2)))))
    found = found.select("doc_id", "version", "item_id", "item", F.explode(places).alias("place"), "at", "runs", F.filter(filled, lambda x: x.isNotNull()).alias("slots"))
    keys = ["doc_id", "version", "item_id", "item", "place"]
    # A group is one item's place in one document: its size is bounded by the item.
    grouped = found.groupBy(*keys).agg(F.count_distinct("at").alias("n_runs"), F.first("runs").alias("item_runs"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    values = F.array_distinct(F.transform("slots", lambda x: x["item_value"]))
    grouped = grouped.where((F.col("n_runs") >= F.least(F.lit(runs), F.col("item_runs"))) & (F.size("slots") == F.size(values)))
    changed = F.size(F.filter("slots", lambda x: x["item_value"] != x["doc_value"]))
    best = grouped.groupBy("doc_id", "version", "item_id").agg(F.max(F.struct(F.col("n_runs").cast("long").alias("n_runs"), (-changed).cast("long").alias("same"), F.size("slots").cast("long").alias("n_slots"), F.col("item_runs").cast("long").alias("item_runs"))).alias("b"))
    return best.select("doc_id", "version", "item_id", "b.n_runs", "b.item_runs", "b.n_slots", (-F.col("b.same")).alias("n_changed"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; all their columns stay, whatever their names."""
    plain, back = set_aside(docs)
    bad = contaminated_pairs(plain, benchmark).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct()
    return back(plain.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_version")), "left_anti"))


def contaminated_sql(width: int = WIDTH, least: int = LEAST, runs: int = RUNS) -> str:
    """contaminated_pairs (without version) for DuckDB, on tables whose doc_id and item_id are unique."""
    def stepped(x: str, steps: list[tuple[str, str]]) -> str:
        for pattern, by in steps:
            x = f"replace({x}, '{pattern}', '{by}')" if by == "_" else f"regexp_replace({x}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
        return x

    words = lambda x: f"string_split(trim({x}, ' '), '  ')"
    marked = lambda x: stepped(f"(' ' || coalesce({x}, '') || ' ')", MARKS)
    pair = f"{words('m')} AS raw, {words(f'lower({stepped(chr(109), BARE)})')} AS canon"
    bare = lambda x: rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '', 'g')"
    return rf"""
    WITH both_cases AS (SELECT item_id, 0 AS small, {marked('text')} AS m FROM benchmark UNION ALL SELECT item_id, 1, {marked('lower(text)')} FROM benchmark),
    items AS (SELECT item_id, small, {pair} FROM both_cases),
    sized AS (SELECT *, least({width}, len(canon)) AS width, len(canon) - least({width}, len(canon)) + 1 AS runs FROM items WHERE len(canon) >= {least}),
    own AS (SELECT item_id, arg_min(runs, small) AS runs FROM sized GROUP BY item_id),
    item_at AS (SELECT *, unnest(range(1, runs + 1)) AS spot FROM sized),
    cut AS (SELECT item_id, small, width, spot, raw[spot:spot + width - 1] AS item_raw, canon[spot:spot + width - 1] AS item_canon FROM item_at),
    item_runs AS (SELECT item_id, width, spot, item_canon, arg_min(item_raw, small) AS item_raw FROM cut GROUP BY ALL),
    marked_texts AS (SELECT doc_id, {marked('text')} AS m FROM documents),
    texts AS (SELECT doc_id, {pair} FROM marked_texts),
    doc_at AS (SELECT doc_id, raw, canon, width, unnest(range(1, len(canon) - width + 2)) AS pos FROM texts, (SELECT DISTINCT width FROM sized)),
    doc_runs AS (SELECT doc_id, width, pos, raw[pos:pos + width - 1] AS doc_raw, canon[pos:pos + width - 1] AS doc_canon FROM doc_at),
    hits AS (SELECT d.doc_id, i.item_id, i.spot, pos - spot AS shift, item_raw, item_canon, doc_raw FROM doc_runs d JOIN item_runs i ON d.width = i.width AND d.doc_canon = i.item_canon),
    placed AS (SELECT *, 0 AS kind, shift AS place FROM hits UNION ALL SELECT *, 1, CAST(floor(shift / {NEAR}) AS BIGINT) FROM hits UNION ALL SELECT *, 2, CAST(floor((shift + {NEAR // 2}) / {NEAR}) AS BIGINT) FROM hits),
    words AS (SELECT doc_id, item_id, kind, place, unnest(item_raw) AS item_word, unnest(doc_raw) AS doc_word, unnest(item_canon) AS canon FROM placed),
    slots AS (SELECT DISTINCT doc_id, item_id, kind, place, {bare("item_word")} AS item_value, {bare("doc_word")} AS doc_value FROM words WHERE contains(canon, '<')),
    per_place AS (SELECT doc_id, item_id, kind, place, count(DISTINCT spot) AS n_runs FROM placed GROUP BY ALL),
    per_slots AS (SELECT doc_id, item_id, kind, place, count(*) AS n_slots, count(DISTINCT item_value) AS n_values, count(*) FILTER (item_value <> doc_value) AS n_changed FROM slots GROUP BY ALL),
    joined AS (SELECT doc_id, item_id, n_runs, own.runs AS item_runs, coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed FROM per_place JOIN own USING (item_id) LEFT JOIN per_slots USING (doc_id, item_id, kind, place)
             WHERE n_runs >= least({runs}, own.runs) AND coalesce(n_slots, 0) = coalesce(n_values, 0))
    SELECT doc_id, item_id, n_runs, item_runs, n_slots, n_changed FROM joined
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_runs DESC, n_changed, n_slots DESC) = 1"""
