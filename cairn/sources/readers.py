"""Sources: columnar scans, JSON landing files, dimensions, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Names that mark an article or listing rather than a project page.
NOT_PROJECT_KINDS = ["article", "other"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table, with column pruning where columns are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def json_array(spark: SparkSession, path: str, schema: str | None = None, key: str | None = None) -> DataFrame:
    """A file that is one JSON array (or an object that holds one under ``key``); bad rows go to ``_corrupt_record``."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.select(F.explode_outer(key).alias("item")).select("item.*") if key else df


def json_dimension(spark: SparkSession, path: str, schema: str, key: str, under: str | None = None) -> DataFrame:
    """A dimension with one row per key from a file that is a JSON array, or an object that holds it under a name; rows without a key are dropped, the first of a key stays."""
    wrapped = f"{under} array<struct<{schema}>>" if under else None
    rows = json_array(spark, path, wrapped, under) if under else json_array(spark, path, ", ".join(f"{n} {t}" for n, t in (x.split(":", 1) for x in _fields(schema))))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.first(c).alias(c) for c in rows.columns if c != key))


def _fields(schema: str) -> list[str]:
    """Top-level fields of ``name:type,name:type``."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stream_jsonl(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def dimension(df: DataFrame, limit_bytes: int = 64 << 20) -> DataFrame:
    """Hint to broadcast a dimension whose estimated size is within ``limit_bytes``; larger ones join by shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit_bytes else df


def gallery_entries(pages: DataFrame) -> DataFrame:
    """(page_id, place, href, label): the links of listing pages in order."""
    link = r'<a\s[^>]*href="([^"]*)"[^>]*>([\s\S]*?)</a>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(link), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(link), F.lit(2)).alias("label"))
    rows = pages.select("page_id", F.posexplode(both).alias("place", "link"))
    return rows.select("page_id", "place", F.col("link.href").alias("href"), T.normalise_ws(F.regexp_replace("link.label", "<[^>]+>", " ")).alias("label"))


def page_records(pages: DataFrame) -> DataFrame:
    """Title, language, first heading and links of project pages."""
    tag = lambda name: T.normalise_ws(F.regexp_replace(F.regexp_extract("html", rf"(?i)<{name}[^>]*>([\s\S]*?)</{name}>", 1), "<[^>]+>", " "))
    return pages.select(
        "page_id", T.web_rid("url").alias("rid"), T.norm_url("url").alias("url_key"), tag("title").alias("title"), tag("h1").alias("heading"),
        F.regexp_extract("html", r'<html[^>]*lang="([^"]+)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("n_links"),
    )


def is_page(url: F.Column | str, directories: tuple[str, ...] = ()) -> F.Column:
    """Whether an address has a host of its own: one with a dot that is no directory of other pages."""
    host = T.url_host(url)
    return host.contains(".") & ~host.isin(*directories) if directories else host.contains(".")


def squash(text: F.Column) -> F.Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def lookup(names: DataFrame, records: DataFrame, least: int = 3) -> DataFrame:
    """(name, rid): for each name (name) the first record (rid, title, url) whose title or address holds it; brackets in a name are asides. Names of a lookup are a stated, small set."""
    want = names.select("name", squash(F.regexp_replace("name", r"\([^)]*\)", "")).alias("want")).where(F.length("want") >= least).distinct()
    have = records.select("rid", F.concat_ws(" ", squash(F.col("title")), squash(F.col("url"))).alias("hay"))
    return have.join(dimension(want), F.contains("hay", "want")).groupBy("name").agg(F.min("rid").alias("rid"))


def real_pages(records: DataFrame, kind: str = "kind") -> DataFrame:
    """Drops articles and listings, and addresses without a path."""
    return records.where(~F.coalesce(F.col(kind), F.lit("")).isin(NOT_PROJECT_KINDS)).where(T.url_path("url") != "")
