"""Ingest queries: cleaning, keys, flags, quarantine, tiers, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import udfs as U
from ..sources import readers, sinks
from ..sources.readers import table
from .base import Catalog, sql_list

catalog = Catalog()
query = catalog.query

HOST = r"regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]+)', 1)), '^www\.', '')"
PATH = "regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?[^/?#]+(/[^?#]*)', 1)), '/+$', '')"


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < CASE WHEN source = 'src1' THEN 60 ELSE 250 END THEN 'too_short' END, CASE WHEN lang NOT IN ('en', 'und') THEN 'non_english' END], lambda x: x IS NOT NULL), ',') AS flags FROM documents""")
def quality_flags(spark, d):
    """Too short (one source writes shorter) and non-English."""
    short = F.length("text") < F.when(F.col("source") == "src1", 60).otherwise(250)
    flags = F.array_compact(F.array(F.when(short, "too_short"), F.when(~F.col("lang").isin("en", "und"), "non_english")))
    return table(spark, d, "documents").select("doc_id", F.array_join(flags, ",").alias("flags"))


def _votes(lang: str) -> str:
    return f"len(list_filter(w, lambda x: list_contains({sql_list(T.LANG_WORDS[lang])}, x)))"


_OTHERS = [k for k in T.LANG_WORDS if k != "en"]


@query(f"""WITH v AS (SELECT doc_id, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters, {', '.join(f"{_votes(k)} AS {k}" for k in T.LANG_WORDS)} FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}]+') AS w FROM documents)), b AS (SELECT *, greatest({', '.join(_OTHERS)}) AS best FROM v)
SELECT doc_id, CASE WHEN letters < 20 THEN 'und' WHEN en >= 3 AND en >= best THEN 'en' WHEN best >= 5 AND best >= 2 * en THEN CASE {' '.join(f"WHEN {k} = best THEN '{k}'" for k in _OTHERS)} END ELSE 'und' END AS lang FROM b""")
def lang_guess(spark, d):
    """Language of each text; the SQL leaves out the scripts, which none of these texts is written in."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.guess_lang("text").alias("lang"))


TITLE, TAGLINE = "regexp_extract(text, '^[^.!?\\n]*[.!?]?')", "source"


@query(f"SELECT doc_id, sha1(regexp_replace(lower({TITLE}), '[^a-z0-9]+', '', 'g') || '|' || regexp_replace(lower({TAGLINE}), '[^a-z0-9]+', '', 'g')) AS dedupe_key FROM documents")
def dedupe_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.dedupe_key(T.first_sentence("text"), "source").alias("dedupe_key"))


@query(f"""WITH k AS (SELECT doc_id, source, n_chars, sha1(regexp_replace(lower({TITLE}), '[^a-z0-9]+', '', 'g') || '|' || regexp_replace(lower('x'), '[^a-z0-9]+', '', 'g')) AS k FROM documents)
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n_chars DESC, doc_id) AS n FROM k) WHERE n = 1""")
def dedupe_first(spark, d):
    """First row of each key in a stated order."""
    keyed = table(spark, d, "documents").withColumn("k", T.dedupe_key(T.first_sentence("text"), F.lit("x")))
    first = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n_chars"), "doc_id"))
    return keyed.withColumn("n", first).where("n = 1").select("doc_id", "source")


@query("""WITH r AS (SELECT doc_id, source, coalesce(quality, 0) AS winner, n_chars FROM documents LEFT JOIN labels USING (doc_id)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, n_chars ORDER BY winner DESC, doc_id) AS n FROM r) WHERE n = 1)
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY winner DESC, n_chars DESC, doc_id) <= 200 THEN 1 ELSE 2 END AS tier FROM p""")
def tier_split(spark, d):
    """Winners first, then the longest; one row per project; the first 200 are tier 1. The cut is found by a bounded top-k, not by numbering all rows in one task."""
    rows = table(spark, d, "documents", "doc_id", "source", "n_chars").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left").withColumn("winner", F.coalesce("quality", F.lit(0)))
    one = Window.partitionBy("source", "n_chars").orderBy(F.desc("winner"), "doc_id")
    projects = rows.withColumn("n", F.row_number().over(one)).where("n = 1")
    first = projects.orderBy(F.desc("winner"), F.desc("n_chars"), "doc_id").limit(200).select(F.col("doc_id").alias("first_id"))
    return projects.join(first, F.col("doc_id") == F.col("first_id"), "left").select("doc_id", F.when(F.col("first_id").isNotNull(), 1).otherwise(2).alias("tier"))


@query(f"SELECT page_id, {HOST} AS host, {HOST} || {PATH} AS url_key, list_last(string_split({PATH}, '/')) AS slug, 'web:' || left(sha1({HOST} || {PATH}), 12) AS rid FROM pages")
def url_keys(spark, d):
    return table(spark, d, "pages", "page_id", "url").select("page_id", T.url_host("url").alias("host"), T.norm_url("url").alias("url_key"), T.slug_from_url("url").alias("slug"), T.web_rid("url").alias("rid"))


@query(f"SELECT page_id FROM pages WHERE lower(url) SIMILAR TO 'https?://.*' AND {PATH} <> ''")
def public_pages(spark, d):
    """Public addresses with a path."""
    return table(spark, d, "pages", "page_id", "url").where(T.host_is_public("url") & (T.url_path("url") != "")).select("page_id")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?i)<title[^>]*>([\s\S]*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title,
regexp_extract(html, '<html[^>]*lang="([^"]+)"', 1) AS lang, CAST(len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS INT) AS n_links FROM pages""")
def page_records(spark, d):
    return readers.page_records(table(spark, d, "pages")).select("page_id", "title", "lang", "n_links")


@query(r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>([\s\S]*?)</a>', 1) AS h, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>([\s\S]*?)</a>', 2) AS t FROM pages)
SELECT page_id, CAST(i - 1 AS INT) AS place, h[i] AS href, trim(regexp_replace(regexp_replace(t[i], '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM l)""")
def gallery_entries(spark, d):
    return readers.gallery_entries(table(spark, d, "pages"))


@query()
def html_to_text(spark, d):
    text = U.html_to_text("html")
    return table(spark, d, "pages", "page_id", "html").select("page_id", text.alias("text")).withColumn("n_words", T.count_words("text"))


@query()
def page_pitches(spark, d):
    """Sections and pitch of each page; the first heading is its tagline where it isn't the title."""
    tag = lambda name: T.normalise_ws(F.regexp_replace(F.regexp_extract("html", rf"(?i)<{name}[^>]*>([\s\S]*?)</{name}>", 1), "<[^>]+>", " "))
    rows = table(spark, d, "pages").select("page_id", tag("title").alias("title"), tag("h1").alias("tagline"), "html")
    parts = rows.select("page_id", "title", U.page_parts("title", "tagline", "html").alias("x"))
    return parts.select("page_id", "title", F.map_keys("x.sections").alias("section_names"), F.col("x.pitch").alias("pitch"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, CAST(CASE WHEN length(trim(text)) > 0 THEN len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) ELSE 0 END AS INT) AS n_words FROM documents")
def normalised_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalise_ws("text").alias("text"), T.count_words("text").alias("n_words"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN lower(c_name) || '|c#' WHEN 'BUILDING' THEN 'a|' || lower(c_name) WHEN 'FURNITURE' THEN lower(c_name) || '|flask' ELSE '' END AS items FROM customer")
def parse_listish(spark, d):
    """Lists that come as text: Python lists, JSON lists, words between commas, and words for nothing."""
    name, kind = F.lower("c_name"), F.col("c_mktsegment")
    raw = (
        F.when(kind == "AUTOMOBILE", F.concat(F.lit("['"), name, F.lit("', 'c#']"))).when(kind == "BUILDING", F.concat(F.lit('["a", null, " '), name, F.lit(' "]')))
        .when(kind == "FURNITURE", F.concat(name, F.lit(", flask , "))).when(kind == "HOUSEHOLD", "[]").otherwise("None")
    )
    return table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment").select("c_custkey", F.array_join(T.parse_listish(raw), "|").alias("items"))


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'nan' WHEN doc_id % 11 = 0 THEN '' ELSE source END AS source, n_chars FROM documents)
SELECT doc_id, CASE WHEN source IS NULL OR lower(trim(source)) IN ('', 'nan', 'none', 'null') THEN 'missing source' WHEN n_chars > 20000 THEN 'too long' END AS ingest_error FROM r
WHERE source IS NULL OR lower(trim(source)) IN ('', 'nan', 'none', 'null') OR n_chars > 20000""")
def quarantine(spark, d):
    """Rejected rows with the reason."""
    rows = table(spark, d, "documents", "doc_id", "source", "n_chars").withColumn("source", F.when(F.col("doc_id") % 7 == 0, "nan").when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("source")))
    error = F.when(T.is_missing("source"), "missing source").when(F.col("n_chars") > 20000, "too long")
    return sinks.split_quarantine(rows, error)[1].select("doc_id", "ingest_error")


@query("""WITH a AS (SELECT doc_id AS rid, n_chars AS v, 1 AS version FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS rid, n_chars + 1 AS v, 2 AS version FROM documents WHERE doc_id % 3 = 0)
SELECT rid, max_by(v, version) AS v, max(version) AS version FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY rid""")
def upsert_last_wins(spark, d):
    rows = table(spark, d, "documents", "doc_id", "n_chars")
    a = rows.where("doc_id % 2 = 0").select(F.col("doc_id").alias("rid"), F.col("n_chars").alias("v"), F.lit(1).alias("version"))
    b = rows.where("doc_id % 3 = 0").select(F.col("doc_id").alias("rid"), (F.col("n_chars") + 1).alias("v"), F.lit(2).alias("version"))
    return sinks.upsert(a, b, "rid", "version")


@query("SELECT doc_id AS rid FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0")
def create_skip_existing(spark, d):
    rows = table(spark, d, "documents", "doc_id").withColumnRenamed("doc_id", "rid")
    return sinks.create(rows.where("rid % 2 = 0"), rows.where("rid % 3 = 0"), "rid")


@query("SELECT doc_id AS rid, CASE WHEN doc_id % 3 = 0 AND doc_id % 6 <> 0 THEN 'patched' ELSE source END AS source FROM documents")
def partial_update(spark, d):
    """Null values of a patch change nothing."""
    rows = table(spark, d, "documents", "doc_id", "source").withColumnRenamed("doc_id", "rid")
    patch = rows.where("rid % 3 = 0").select("rid", F.when(F.col("rid") % 6 != 0, "patched").alias("source"))
    return sinks.update(rows, patch, "rid")


@query("""SELECT doc_id, source || ':' || doc_id AS rid, coalesce(quality = 1, false) AS is_winner, CAST(coalesce(CASE WHEN doc_id % 4 = 0 THEN DATE '2020-05-17' END, CASE WHEN doc_id % 4 = 1 THEN make_date(2000 + doc_id % 25, 1, 1) END) AS VARCHAR) AS first_seen,
CASE WHEN length(text) <= 256 THEN text END AS title_kw FROM documents LEFT JOIN labels USING (doc_id)""")
def project_document(spark, d):
    """Indexed form of a record: first seen on its date, else on the first day of its year; long titles have no keyword form."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    date = F.when(F.col("doc_id") % 4 == 0, F.to_date(F.lit("2020-05-17")))
    year = F.when(F.col("doc_id") % 4 == 1, (2000 + F.col("doc_id") % 25).cast("int"))
    return rows.select("doc_id", F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("rid"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_winner"), F.coalesce(date, F.make_date(year, F.lit(1), F.lit(1))).cast("string").alias("first_seen"), F.when(F.length("text") <= 256, F.col("text")).alias("title_kw"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE strftime(o_orderdate + INTERVAL (CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 2 END) DAY, '%Y-%m-%d') END AS ends FROM orders")
def submission_dates(spark, d):
    """End of a period in any of four spellings; null where it names none."""
    at = F.to_date("o_orderdate")
    to = F.date_add(at, 2)
    text = lambda c, f: F.date_format(c, f)
    within = F.concat_ws(" - ", text(at, "MMM dd"), F.when(F.month(at) == F.month(to), text(to, "dd, yyyy")).otherwise(text(to, "MMM dd, yyyy")))
    period = F.when(F.col("o_orderpriority") == "5-LOW", "soon").when(F.col("o_orderstatus") == "O", text(at, "MMM dd, yyyy")).when((F.col("o_orderstatus") == "P") | (F.year(at) != F.year(to)), F.concat_ws(" - ", text(at, "MMM dd, yyyy"), text(to, "MMM dd, yyyy"))).otherwise(within)
    rows = table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority").select("o_orderkey", period.alias("period"))
    end = F.trim(F.element_at(F.split("period", " - "), -1))
    year, day = F.regexp_extract(end, r"(\d{4})$", 1), F.regexp_extract(end, r"(\d{1,2}),", 1)
    month = F.coalesce(F.nullif(F.regexp_extract(end, "^([A-Z][a-z]{2})", 1), F.lit("")), F.regexp_extract("period", "^([A-Z][a-z]{2})", 1))
    return rows.select("o_orderkey", F.try_to_date(F.concat_ws(" ", month, day, year), "MMM d yyyy").cast("string").alias("ends"))


@query("""WITH b AS (SELECT o_orderkey, o_orderpriority AS p, year(o_orderdate) AS y, strftime(o_orderdate + to_days(CAST(floor(o_totalprice) AS INT) % 900), '%Y-%m-%d') AS launched FROM orders),
c AS (SELECT *, CASE WHEN p = '1-URGENT' THEN y WHEN p IN ('2-HIGH', '5-LOW') THEN 2000 + y % 100 END AS year FROM b) SELECT o_orderkey, CAST(year AS VARCHAR) AS year, CASE WHEN abs(CAST(left(launched, 4) AS INT) - year) <= 1 THEN launched END AS launched FROM c""")
def batch_years(spark, d):
    """Year of a batch name; the launch date counts only within a year of it."""
    at, p = F.to_date("o_orderdate"), F.col("o_orderpriority")
    batch = F.when(p == "1-URGENT", F.concat(F.lit("Winter "), F.year(at).cast("string"))).when(p == "2-HIGH", F.concat(F.lit("W"), F.date_format(at, "yy"))).when(p == "5-LOW", F.concat(F.lit("IK"), F.date_format(at, "yy"))).otherwise("unspecified")
    seconds = F.unix_timestamp(F.date_add(at, (F.floor("o_totalprice") % 900).cast("int")).cast("timestamp"))
    rows = table(spark, d, "orders").select("o_orderkey", batch.alias("batch"), seconds.alias("at"))
    year = F.coalesce(F.nullif(F.regexp_extract("batch", r"(\d{4})", 1), F.lit("")), F.concat(F.lit("20"), F.nullif(F.regexp_extract("batch", r"^[A-Z]{1,2}(\d{2})$", 1), F.lit("")))).cast("int")
    launched = F.to_date(F.timestamp_seconds("at"))
    return rows.select("o_orderkey", year.cast("string").alias("year"), F.when(F.abs(F.year(launched) - year) <= 1, launched).cast("string").alias("launched"))


@query("SELECT count(*) FILTER (WHERE e IS NULL) AS ok, count(*) FILTER (WHERE e = 'too_short') AS skipped, count(*) FILTER (WHERE e = 'too_long') AS quarantined FROM (SELECT CASE WHEN n_chars < 250 THEN 'too_short' WHEN n_chars > 20000 THEN 'too_long' END AS e FROM documents)")
def ingest_stats(spark, d):
    e = F.when(F.col("n_chars") < 250, "too_short").when(F.col("n_chars") > 20000, "too_long")
    return table(spark, d, "documents", "n_chars").agg(F.count_if(e.isNull()).alias("ok"), F.count_if(e == "too_short").alias("skipped"), F.count_if(e == "too_long").alias("quarantined"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS n FROM documents) WHERE n > 900")
def resume_after_offset(spark, d):
    return sinks.resume_after(table(spark, d, "documents", "doc_id", "source"), ["source", "doc_id"], 900).select("doc_id")
