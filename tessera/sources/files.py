"""Files, lists and archives in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P

#: Suffixes of the kinds that an inventory takes.
KINDS = {"photo": [".jpg", ".jpeg", ".png", ".heic", ".webp"], "video": [".mp4", ".mov", ".mkv", ".avi"]}
TRASH = ["$recycle.bin", ".trash", "trash", "node_modules", ".git"]


def kind_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, endings in KINDS.items():
        out = F.when(P.suffix(path).isin(*endings), F.lit(kind)).otherwise(out)
    return out


def inventory(spark: SparkSession, folder: str, source: str, block: list[str] = [], allow: list[str] = []) -> DataFrame:  # noqa: B006
    """(path, size, modified, kind) of the photos and videos below a folder, as keys of the source.

    Spark lists the folder, in whatever store it is in; contents are not read. Trash folders and blocked paths are left out.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    base = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    native = F.regexp_replace(F.col("path"), f"^.*?{_quoted(base)}(?=/)", "")
    keyed = listed.select(F.concat(F.lit(f"{source}:"), native).alias("path"), F.col("length").alias("size"), "modificationTime")
    trash = F.arrays_overlap(F.transform(P.parts(F.col("path")), lambda x: F.lower(x)), F.array(*map(F.lit, TRASH)))
    rows = keyed.withColumn("kind", kind_of(F.col("path"))).where(F.col("kind").isNotNull() & ~trash & ~P.blocked(F.col("path"), block, allow))
    return rows.select("path", "size", F.unix_micros("modificationTime").alias("modified"), "kind")


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in text)


def quick_key(content: Column, edge: int = 65536) -> Column:
    """SHA-1 of the size and the first and last bytes: a cheap test before a whole hash."""
    size = F.octet_length(content)
    tail = F.substring(content, F.greatest(F.lit(1), size - edge + 1), edge)
    return F.sha1(F.concat(F.encode(size.cast("string"), "UTF-8"), F.lit(b"\x00"), F.substring(content, 1, edge), tail))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(city, name, lat, lon, population) of a tab-separated list."""
    return spark.read.csv(path, sep="\t", schema="city long, name string, lat double, lon double, population long")


def export_hashes(df: DataFrame, copies: DataFrame, path: str) -> None:
    """Hashes of files that aren't copies, as JSON lines for another site."""
    df.join(copies.select("path"), "path", "left_anti").select("path", "sha", "size").write.mode("overwrite").json(path)


def answers(df: DataFrame, text: str, expected: DataFrame) -> DataFrame:
    """(item, label) out of answers in JSON, whatever stands around it; raises if the items aren't exactly the expected ones."""
    parsed = df.select(F.explode(F.from_json(P.salvaged_json(F.col(text)), T.MapType(T.StringType(), T.ArrayType(T.StringType())))).alias("item", "labels"))
    asked = expected.select("item").distinct()
    odd = parsed.select("item").exceptAll(asked).union(asked.exceptAll(parsed.select("item")))
    if not odd.isEmpty():
        raise ValueError(f"items asked and answered differ, e.g. {odd.first().item!r}")
    return parsed.select("item", F.explode("labels").alias("label"))


def frame_times(duration: Column, count: int) -> Column:
    """Middles of `count` equal parts of a clip, in seconds."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.round(duration * (i + 0.5) / count, 6))


def every(duration: Column, seconds: float) -> Column:
    """Times every so many seconds from the start."""
    return F.transform(F.sequence(F.lit(0), F.floor(duration / seconds).cast("int")), lambda i: i * seconds)
