"""A gazetteer from a public list of places: filtered, named in Cyrillic where a good name is known, written and read back."""

from __future__ import annotations

import difflib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of places that are parts of a town.
PARTS = ["PPLX", "PPLH", "PPLQ", "PPLW"]
#: Latin spellings of Cyrillic letters.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
#: Fixed value: what a name in the wanted alphabet looks like.
NAME = "^[А-Яа-яЁё][А-Яа-яЁё \\-]*$"
#: The longest name that is looked at, and the least likeness that a name must have.
LONGEST, LEAST = 40, 0.45
#: Columns of the list of places.
PLACES = ["id", "name", "ascii", "alternates", "lat", "lon", "class", "kind", "country", "other", "a1", "a2", "a3", "a4", "population", "height", "model", "zone", "changed"]


def zipped_lines(spark: SparkSession, path: str, ending: str = ".txt") -> DataFrame:
    """(line) of the text files in zip archives. An archive is one task's; its members are unpacked and handed on in parts."""
    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        if member.endswith(ending):
                            with archive.open(member) as opened:
                                lines = io.TextIOWrapper(opened, encoding="utf-8", newline="\n")
                                while part := lines.readlines(1 << 20):
                                    yield pd.DataFrame({"line": [x.rstrip("\n") for x in part]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpacked, "line string")


def listed(lines: DataFrame) -> DataFrame:
    """Places out of (line), tab-separated and never quoted; a line with fewer than fifteen fields is left out."""
    rows = lines.select(F.split("line", "\t").alias("f")).where(F.size("f") >= 15)
    return rows.select(*(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(PLACES)))


def countries(lines: DataFrame) -> DataFrame:
    """(country, title) out of a country list's (line); comments and empty lines are left out."""
    rows = lines.where("line NOT LIKE '#%' AND trim(line) <> ''").select(F.split("line", "\t").alias("f"))
    return rows.where(F.size("f") >= 5).select(F.col("f")[0].alias("country"), F.col("f")[4].alias("title")).dropDuplicates(["country"])


def latin(name: Column) -> Column:
    """A name in Latin letters, letter by letter; other characters stay."""
    table = F.create_map(*(F.lit(x) for pair in LATIN.items() for x in pair))
    return F.array_join(F.transform(F.split(F.lower(name), ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the length of the longest matching blocks over both lengths: 1 for equal texts. Null where one is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def best_names(places: DataFrame, least: float = LEAST) -> DataFrame:
    """(id, best): of each place's (id, ascii, alternates) the alternate in the wanted alphabet that is likest to the name in Latin letters.

    Of equally like ones the first; places without any of `least` are left out. Alternates that can't be meant never reach Python.
    """
    names = places.select("id", F.lower("ascii").alias("_ascii"), F.posexplode(F.split("alternates", ",")).alias("_pos", "_name")).withColumn("_name", F.trim("_name"))
    names = names.where(F.col("_name").rlike(NAME) & (F.char_length("_name") <= LONGEST)).withColumn("_score", likeness(latin(F.col("_name")), F.col("_ascii")))
    best = names.groupBy("id").agg(F.max(F.struct("_score", (-F.col("_pos")).alias("p"), "_name")).alias("_b"))
    return best.where(F.col("_b._score") >= least).select("id", F.col("_b._name").alias("best"))


def built(places: DataFrame, known: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """(id, name, country, lat, lon, population) of listed() places without parts of towns.

    The name is the known (ascii, country, title) one, else the best alternate, else the one in ASCII. Places without a number or a position are left out.
    """
    rows = places.where(~F.coalesce(F.col("kind").isin(*PARTS), F.lit(False)))
    rows = rows.select(F.expr("try_cast(id AS long)").alias("id"), "ascii", "alternates", "country", *(F.expr(f"try_cast({c} AS double)").alias(c) for c in ("lat", "lon")), F.coalesce(F.expr("try_cast(population AS long)"), F.lit(0)).alias("population"))
    rows = rows.where("id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").dropDuplicates(["id"])
    named = rows.join(best_names(rows, least), "id", "left")
    title = F.coalesce("best", "ascii")
    if known is not None:
        named = named.join(known.select("ascii", "country", "title").dropDuplicates(["ascii", "country"]), ["ascii", "country"], "left")
        title = F.coalesce("title", "best", "ascii")
    return named.select("id", title.alias("name"), "country", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "population")


def write(places: DataFrame, titles: DataFrame, path: str) -> None:
    """Places as tab-separated gzip files, one a partition, and a file with the line of `code=name` pairs; tabs and line ends in names become spaces."""
    plain = lambda c: F.regexp_replace(F.col(c), "[\\t\\r\\n]", " ")
    pairs = F.sort_array(F.collect_list(F.concat_ws("=", "country", plain("title"))))  # one per country
    titles.agg(F.concat_ws("\t", F.lit("#countries"), pairs).alias("value")).write.mode("overwrite").text(path, compression="gzip")
    at = [F.format_string("%.4f", c).alias(c) for c in ("lat", "lon")]
    places.select(F.concat_ws("\t", F.col("id").cast("string"), plain("name"), F.coalesce("country", F.lit("")), *at, F.col("population").cast("string")).alias("value")).write.mode("append").text(path, compression="gzip")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(city, name, country, title, lat, lon, population, cell_lat, cell_lon) of a written gazetteer, wherever the line of pairs stands;
    the title of a country that it lacks is its code. Cells are one degree wide."""
    fields = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    pair = fields.where(F.col("f")[0] == "#countries").select(F.explode(F.slice("f", 2, 1 << 20)).alias("pair"))
    titles = pair.select(F.substring_index("pair", "=", 1).alias("country"), F.regexp_extract("pair", "^[^=]*=(.*)$", 1).alias("title")).dropDuplicates(["country"])
    rows = fields.where((F.col("f")[0] != "#countries") & (F.size("f") >= 6))
    rows = rows.select(F.col("f")[0].cast("long").alias("city"), F.col("f")[1].alias("name"), F.col("f")[2].alias("country"), F.col("f")[3].cast("double").alias("lat"), F.col("f")[4].cast("double").alias("lon"), F.coalesce(F.expr("try_cast(f[5] AS long)"), F.lit(0)).alias("population"))
    cells = rows.withColumn("cell_lat", F.floor("lat").cast("int")).withColumn("cell_lon", F.floor("lon").cast("int"))
    return cells.join(titles, "country", "left").withColumn("title", F.coalesce("title", "country"))
