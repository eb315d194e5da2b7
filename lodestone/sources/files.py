"""Sources: text files, scrapes in several folders, sidecars, PDFs; their union in a fixed order."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: A sidecar's line between blocks, and its page mark.
SIDECAR_SEPARATOR = r"(?m)^---\s*$"
SIDECAR_PAGE = r"(?i)<!--\s*page:\s*(\d+)\s*-->"


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """source (file name) and text of each UTF-8 file."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))


def text_pages(texts: DataFrame) -> DataFrame:
    """source, page 1, cleaned text of texts with content."""
    return texts.select("source", F.lit(1).alias("page"), T.clean(F.col("text")).alias("text")).where("text <> ''")


def read_first_of(spark: SparkSession, folders: list[str], glob: str = "*.txt") -> DataFrame:
    """Texts of several folders; of names that differ in case only the one in the first folder is taken, lower-cased."""
    out = None
    for i, folder in enumerate(folders):
        part = read_texts(spark, folder, glob).withColumn("rank", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return first_of(out)


def first_of(files: DataFrame) -> DataFrame:
    """Of files (source, text, rank) the first of each lower-cased name."""
    w = Window.partitionBy(F.lower("source")).orderBy("rank", "source")
    return files.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(F.lower("source").alias("source"), "text")


def sidecar_blocks(sidecars: DataFrame, *, normal_form: bool = True) -> DataFrame:
    """source, block_no, page, text of hand-made sidecars: blocks between --- lines, each with an optional page mark."""
    parts = sidecars.select("source", F.posexplode(F.split(F.coalesce("text", F.lit("")), SIDECAR_SEPARATOR, -1)).alias("block_no", "block"))
    mark = F.regexp_extract("block", SIDECAR_PAGE, 1)
    page = F.when(mark == "", 1).otherwise(mark.cast("int"))
    at = F.regexp_instr("block", F.lit(SIDECAR_PAGE))
    whole = F.regexp_extract("block", SIDECAR_PAGE, 0)
    bare = F.when(mark == "", F.col("block")).otherwise(F.concat(F.substring("block", F.lit(1), at - 1), F.substring("block", at + F.length(whole), F.length("block"))))
    return parts.select("source", "block_no", page.alias("page"), T.clean(bare, normal_form=normal_form).alias("text")).where("text <> ''")


def without_sidecar(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Files that have no sidecar of the same name."""
    return files.join(sidecars.select("source").distinct(), "source", "left_anti")


def read_pdf_words(spark: SparkSession, path: str, decode: Callable[[bytes], list[dict]]) -> DataFrame:
    """Word boxes of PDFs; decode gives a dict for each word: page (from 1), text, x0, x1, top, page_left, page_right."""
    columns = ["page", "text", "x0", "x1", "top", "page_left", "page_right"]

    def run(batches):
        for files in batches:
            for name, content in zip(files["source"], files["content"]):
                yield pd.DataFrame(decode(content), columns=columns).assign(source=name)[["source", *columns]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(F.col("_metadata.file_name").alias("source"), "content")
    return files.mapInPandas(run, "source string, page int, text string, x0 double, x1 double, top double, page_left double, page_right double")


def in_source_order(parts: list[DataFrame]) -> DataFrame:
    """The union of sources with the rank of each, which decides the order of ids."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("source_rank", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def write_texts(texts: DataFrame, path: str) -> None:
    """Cleaned texts, replacing what was there; names are those of the sources in lower case."""
    texts.select(F.lower("source").alias("source"), "text").write.mode("overwrite").parquet(path)


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """Texts from write_texts."""
    return spark.read.schema("source string, text string").parquet(path)


def write_chunks_json(chunks: DataFrame, path: str) -> None:
    """The chunk table as JSON lines, a file for each task; null fields are written as null."""
    chunks.select("id", "text", "source", "page", "disaster_type").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_chunks_json(spark: SparkSession, path: str, *, one_array: bool = False) -> DataFrame:
    """Chunks from JSON: lines, or files that are one array each."""
    from lodestone.schemas import CHUNK

    return spark.read.schema(CHUNK).option("multiLine", one_array).option("mode", "FAILFAST").json(path)


def geojson_features(collections: DataFrame) -> DataFrame:
    """kind, object_id, name, geometry_type, coordinates (JSON), n_positions of features of any geometry, and west, south, east, north.

    collections has kind and json (a feature collection).  Features without geometry have none of these.
    """
    schema = "features ARRAY<STRUCT<geometry: STRUCT<type: STRING, coordinates: STRING>, properties: MAP<STRING, STRING>>>"
    f = collections.select("kind", F.explode(F.from_json("json", schema)["features"]).alias("f"))
    number = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    position = rf"\[\s*({number})\s*,\s*({number})\s*(?:,\s*{number}\s*)*\]"
    at = F.col("f.geometry.coordinates")
    axis = lambda g: F.transform(F.regexp_extract_all(at, F.lit(position), F.lit(g)), lambda x: x.cast("double"))
    lng, lat = axis(1), axis(2)
    property_of = lambda n: F.col("f.properties")[n]
    return f.select(
        "kind", property_of("OBJECTID").cast("long").alias("object_id"), property_of("NAME").alias("name"), F.col("f.geometry.type").alias("geometry_type"), at.alias("coordinates"), F.size(lng).alias("n_positions"),
        F.array_min(lng).alias("west"), F.array_min(lat).alias("south"), F.array_max(lng).alias("east"), F.array_max(lat).alias("north"),
    )


def geojson_points(collections: DataFrame) -> DataFrame:
    """kind, object_id, name, address, lat, lng of point features; a feature's coordinates are (lng, lat).

    collections has kind and json (a feature collection).
    """
    from lodestone.schemas import GEO_FEATURES

    f = F.explode(F.from_json("json", GEO_FEATURES)["features"]).alias("f")
    at: Column = F.col("f.geometry.coordinates")
    p = "f.properties"
    return collections.select("kind", f).select("kind", F.col(f"{p}.OBJECTID").alias("object_id"), F.col(f"{p}.NAME").alias("name"), F.col(f"{p}.ADDRESS").alias("address"), F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lng"))
