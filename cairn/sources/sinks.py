"""Sinks: idempotent upsert, create, partial update, quarantine, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(current: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Last version of each key, new rows winning ties."""
    both = current.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.desc("__new"), F.desc(order))
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__new")


def create(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key doesn't exist yet."""
    return new.join(current.select(key), key, "left_anti")


def update(current: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Current rows with the patch's non-null values."""
    names = [c for c in patch.columns if c != key]
    renamed = patch.select(key, *(F.col(c).alias(f"__{c}") for c in names))
    return current.join(renamed, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in names}).drop(*(f"__{c}" for c in names))


def split_quarantine(df: DataFrame, error: F.Column, vector_cols: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with ingest_error and without vectors)."""
    marked = df.withColumn("ingest_error", error)
    return marked.where("ingest_error is null").drop("ingest_error"), marked.where("ingest_error is not null").drop(*vector_cols)


def write_jsonl(events: DataFrame, path: str) -> None:
    """One JSON object a line, null fields left out; a rewrite replaces what was there."""
    events.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def documents(records: DataFrame, first_seen: F.Column | None = None) -> DataFrame:
    """Indexed form of records (rid, year, date, prizes, sections and any other columns): prizes as one text, first seen on the given day, else its own date, else the first day of its
    year; empty maps and lists of sections become null, so ``to_json`` leaves them out."""
    dated = F.coalesce(*([first_seen] if first_seen is not None else []), F.col("date"), F.make_date("year", F.lit(1), F.lit(1)))
    out = records.withColumns({"prize": F.when(F.size("prizes") > 0, F.array_join("prizes", "; ")), "is_winner": F.size("prizes") > 0, "first_seen_at": dated.cast("string"), "date": F.col("date").cast("string")})
    return out.withColumn("sections", F.when(F.size("sections") > 0, F.col("sections"))).drop("prizes")


def resume_after(df: DataFrame, order: list, offset: int, ranges: int = 64) -> DataFrame:
    """Rows after ``offset`` of a deterministic order. The order is cut into ranges by its first column; rows are numbered within the range that holds the offset only,
    and later ranges pass whole, so no task sorts all rows. (A keyset needs no numbering at all.)"""
    if offset <= 0:
        return df
    lead = order[0]
    counts = df.groupBy(lead).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(lead).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = counts.withColumn("before", before).where(F.col("before") <= offset).agg(F.max("before").alias("before"), F.max(lead).alias("lead")).first()
    if at["before"] is None:
        return df
    rest = df.where(F.col(lead).isNotNull() if at["lead"] is None else F.col(lead) > F.lit(at["lead"]))  # nulls come first
    same = df.where(F.col(lead).eqNullSafe(F.lit(at["lead"])))
    numbered = same.withColumn("__n", F.row_number().over(Window.orderBy(*order))).where(F.col("__n") > offset - at["before"]).drop("__n")
    return rest.unionByName(numbered)


def keyset_page(df: DataFrame, year: str, rid: str, after: tuple | None, size: int) -> DataFrame:
    """The next page in the order year descending (missing last), rid ascending."""
    if after is not None:
        y, r = after
        beyond = F.col(year).isNull() & ((F.lit(y).isNotNull()) | (F.col(rid) > r)) if y is None else (F.col(year) < y) | F.col(year).isNull() | ((F.col(year) == y) & (F.col(rid) > r))
        df = df.where(beyond if y is not None else F.col(year).isNull() & (F.col(rid) > r))
    return df.orderBy(F.col(year).desc_nulls_last(), rid).limit(size)
