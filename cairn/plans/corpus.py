"""Corpus statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..operators import corpus as C
from ..sources.readers import table
from .base import TOKENS, WORDS, Catalog, sql_list

catalog = Catalog()
query = catalog.query

FACETS = ["thing", "thble", "thtion", "ering"]
FLAGS = "list_concat(CASE WHEN length(text) < 250 THEN ['too_short'] ELSE [] END, CASE WHEN lang NOT IN ('en', 'und') THEN ['non_english'] ELSE [] END)"


def docs(spark, d):
    return table(spark, d, "documents", "doc_id", "text", "lang", "source", "n_chars").withColumn("words", T.words("text"))


@query(f"""SELECT source, count(*) AS projects, count(*) FILTER (WHERE quality = 1) AS winners FROM documents LEFT JOIN labels USING (doc_id)
WHERE list_has_all({WORDS}, ['the', 'and']) GROUP BY source""")
def crowding_by_group(spark, d):
    """Flagship: projects and winners by source among documents that hold all keywords."""
    labels = table(spark, d, "labels", "doc_id", "quality")
    hits = docs(spark, d).where(T.match_all(F.col("words"), ["the", "and"])).select("doc_id", "source")
    return hits.join(labels, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("projects"), F.count_if(F.col("quality") == 1).alias("winners"))


@query(f"SELECT lang, count(*) AS n FROM documents WHERE list_has_any({WORDS}, {sql_list(FACETS)}) GROUP BY lang")
def match_any(spark, d):
    return docs(spark, d).where(T.match_any(F.col("words"), FACETS)).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT lang, count(*) AS n FROM documents WHERE list_has_all({WORDS}, ['thing', 'thtion']) GROUP BY lang")
def match_all(spark, d):
    return docs(spark, d).where(T.match_all(F.col("words"), ["thing", "thtion"])).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT source, count(*) AS n FROM documents WHERE len(list_intersect(list_distinct({WORDS}), {sql_list(FACETS)})) >= 2 GROUP BY source")
def match_msm(spark, d):
    """Two of four facet words suffice."""
    return docs(spark, d).where(T.match_msm(F.array_distinct("words"), FACETS)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, source FROM documents WHERE NOT (length(text) < 250 OR lang NOT IN ('en', 'und'))")
def exclusion_filter(spark, d):
    """The predicate of every search: neither too short nor of another language."""
    flags = F.array_compact(F.array(F.when(F.length("text") < 250, "too_short"), F.when(~F.col("lang").isin("en", "und"), "non_english")))
    return docs(spark, d).where(~F.arrays_overlap(flags, F.array(F.lit("too_short"), F.lit("non_english")))).select("doc_id", "source")


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS})) AS term FROM documents) GROUP BY term ORDER BY df DESC, term LIMIT 50")
def term_df(spark, d):
    return C.top_terms(docs(spark, d), T.tokens("text"), 50)


@query(f"""SELECT count(*) AS n, count(*) FILTER (WHERE list_contains(w, 'thing')) AS purpose, count(*) FILTER (WHERE list_contains(w, 'thtion')) AS mechanism,
count(*) FILTER (WHERE list_has_all(w, ['thing', 'thtion'])) AS both FROM (SELECT {WORDS} AS w FROM documents)""")
def corpus_size_pair_counts(spark, d):
    has = lambda w: F.array_contains("words", w)
    return C.counts_in_one_pass(docs(spark, d), {"purpose": has("thing"), "mechanism": has("thtion"), "both": has("thing") & has("thtion")})


@query(f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark), n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS})) AS term FROM documents) GROUP BY term),
s AS (SELECT query_id, term, n, ln((n + 1) / (coalesce(df, 0) + 1)) AS idf FROM q LEFT JOIN df USING (term), n),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY idf DESC, term) AS r FROM s)
SELECT query_id, round(avg(idf), 6) AS mean_idf, round(avg(idf) / ln(max(n) + 1), 6) AS rarity FROM r WHERE r <= 3 GROUP BY query_id""")
def idf_topk_facets(spark, d):
    corpus, items = docs(spark, d), table(spark, d, "benchmark", "item_id", "text")
    queries = items.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.tokens("text"))).alias("term")).distinct()
    out = C.facet_rarity(queries, C.document_frequency(corpus, T.tokens("text")), corpus.agg(F.count(F.lit(1)).alias("n")))
    return out.select("query_id", F.round("mean_idf", 6).alias("mean_idf"), F.round("rarity", 6).alias("rarity"))


PAIRS = [(a, b) for i, a in enumerate(FACETS) for b in FACETS[i + 1 :]]


@query(f"""WITH d AS (SELECT {WORDS} AS w FROM documents), p AS (SELECT unnest([{', '.join(f"struct_pack(a := '{a}', b := '{b}')" for a, b in PAIRS)}]) AS p),
c AS (SELECT p.a AS a, p.b AS b, count(*) AS n, count(*) FILTER (WHERE list_contains(w, p.a)) AS na, count(*) FILTER (WHERE list_contains(w, p.b)) AS nb,
count(*) FILTER (WHERE list_contains(w, p.a) AND list_contains(w, p.b)) AS nab FROM d, p GROUP BY 1, 2)
SELECT a, b, nab, round(CASE WHEN na = 0 OR nb = 0 THEN NULL WHEN nab = 0 THEN -1 WHEN nab >= n THEN 1 ELSE greatest(-1, least(1, ln((nab / n) * n * n / (na * nb)) / -ln(nab / n))) END, 6) AS npmi,
round((1 - CASE WHEN na = 0 OR nb = 0 THEN NULL WHEN nab = 0 THEN -1 WHEN nab >= n THEN 1 ELSE greatest(-1, least(1, ln((nab / n) * n * n / (na * nb)) / -ln(nab / n))) END) / 2, 6) AS atypicality FROM c""")
def npmi_pairs(spark, d):
    """All counts of all pairs from one scan, then one row per pair."""
    has = lambda w: F.array_contains("words", w)
    conditions = {f"f_{w}": has(w) for w in FACETS} | {f"p_{a}_{b}": has(a) & has(b) for a, b in PAIRS}
    counts = C.counts_in_one_pass(docs(spark, d), conditions)
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"f_{a}").alias("na"), F.col(f"f_{b}").alias("nb"), F.col(f"p_{a}_{b}").alias("nab")) for a, b in PAIRS)))
    long = counts.select("n", rows.alias("r")).select("n", "r.*")
    value = S.npmi(F.col("n"), F.col("na"), F.col("nb"), F.col("nab"))
    return long.select("a", "b", "nab", F.round(value, 6).alias("npmi"), F.round(S.atypicality(value), 6).alias("atypicality"))


@query(f"""SELECT term, df, round(greatest(0, least(1, 1 - ln(1 + df) / ln(2001))), 6) AS rarity, round(greatest(0, least(1, 1 - ln(1 + df) / ln(201))), 6) AS pair_rarity
FROM (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS})) AS term FROM documents) GROUP BY term)""")
def rarity_from_df(spark, d):
    df = C.document_frequency(docs(spark, d), T.tokens("text"))
    return df.select("term", "df", F.round(S.rarity_from_df(F.col("df")), 6).alias("rarity"), F.round(S.rarity_from_df(F.col("df"), S.PAIR_CAP), 6).alias("pair_rarity"))


@query(f"""WITH c AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(list_distinct({TOKENS})) AS term FROM documents) GROUP BY 1, 2)
SELECT lang, term, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS r FROM c) WHERE r <= 15""")
def cliche_terms_topk(spark, d):
    from pyspark.sql.window import Window

    counts = docs(spark, d).select("lang", F.explode(F.array_distinct(T.tokens("text"))).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))
    return counts.withColumn("r", rank).where("r <= 15").drop("r")


@query(f"""WITH d AS (SELECT DISTINCT text FROM documents), r AS (SELECT CAST(list_contains({WORDS}, 'thing') AS INT) AS fg, list_distinct({TOKENS}) AS terms FROM d),
s AS (SELECT CAST(sum(fg) AS DOUBLE) AS fn, CAST(count(*) AS DOUBLE) AS bn FROM r),
c AS (SELECT term, CAST(sum(fg) AS BIGINT) AS f, count(*) AS b FROM (SELECT fg, unnest(terms) AS term FROM r) GROUP BY term HAVING sum(fg) >= 3)
SELECT term, f AS fg_count, b AS bg_count, round(2 * (CASE WHEN f > 0 THEN f * ln(f / (fn * (b / bn))) ELSE 0 END + CASE WHEN fn - f > 0 THEN (fn - f) * ln((fn - f) / (fn * (1 - b / bn))) ELSE 0 END
 + CASE WHEN b - f > 0 THEN (b - f) * ln((b - f) / ((bn - fn) * (b / bn))) ELSE 0 END + CASE WHEN bn - fn - (b - f) > 0 THEN (bn - fn - (b - f)) * ln((bn - fn - (b - f)) / ((bn - fn) * (1 - b / bn))) ELSE 0 END), 4) AS score
FROM c, s WHERE f / fn > b / bn ORDER BY score DESC, term LIMIT 20""")
def significant_terms(spark, d):
    return C.significant_terms(docs(spark, d), "text", T.content("words"), F.array_contains("words", "thing"))


@query(f"""WITH r AS (SELECT CAST(list_contains({WORDS}, 'ering') AS INT) AS near, unnest(list_distinct({TOKENS})) AS term FROM documents)
SELECT term, count(*) AS global_count, CAST(sum(near) AS BIGINT) AS neighbourhood_count FROM r GROUP BY term HAVING count(*) >= 25 AND sum(near) <= 1 ORDER BY global_count DESC, term LIMIT 25""")
def whitespace_candidates(spark, d):
    return C.whitespace_candidates(docs(spark, d), T.content("words"), F.array_contains("words", "ering"), min_global=25)


@query("WITH c AS (SELECT 'documents' AS corpus, count(*) AS n FROM documents UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem) SELECT corpus, CAST(CASE WHEN n >= 100000 THEN 500 ELSE greatest(25, round_even(500 * n / 262000, 0)) END AS INT) AS min_global FROM c")
def effective_min_global(spark, d):
    """Least global count by the size of a corpus, for tables of three sizes."""
    sizes = [table(spark, d, name).agg(F.lit(name).alias("corpus"), F.count(F.lit(1)).alias("n")) for name in ("documents", "orders", "lineitem")]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).select("corpus", C.effective_min_global(F.col("n")).alias("min_global"))


@query(f"SELECT count(*) AS projects, max(n_chars) AS latest FROM documents WHERE list_has_all({WORDS}, ['thing']) AND list_has_all({WORDS}, ['thble'])")
def combination_rarity(spark, d):
    return docs(spark, d).where(T.match_all(F.col("words"), ["thing"]) & T.match_all(F.col("words"), ["thble"])).agg(F.count(F.lit(1)).alias("projects"), F.max("n_chars").alias("latest"))


@query("SELECT doc_id FROM documents WHERE n_chars >= 100 ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def sample_seeded(spark, d):
    """A repeatable random sample: the 50 smallest hashes of seed and id."""
    return docs(spark, d).where("n_chars >= 100").select("doc_id").orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), "doc_id").limit(50)


@query(f"""WITH d AS (SELECT *, {WORDS} AS w FROM documents)
SELECT year, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS winners FROM (SELECT 2000 + doc_id % 25 AS year, quality FROM d LEFT JOIN labels USING (doc_id) WHERE list_contains(w, 'thing')) GROUP BY year ORDER BY year LIMIT 12""")
def year_buckets(spark, d):
    """The first 12 years among the matches, with winners."""
    near = docs(spark, d).where(F.array_contains("words", "thing")).select("doc_id", (2000 + F.col("doc_id") % 25).alias("year"))
    rows = near.join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("winners")).orderBy("year").limit(12)


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({WORDS})) AS term FROM documents JOIN labels USING (doc_id) WHERE quality = 1) WHERE term IN {tuple(FACETS)} GROUP BY term")
def included_terms(spark, d):
    """Counts of given terms over a set of ids."""
    chosen = table(spark, d, "labels", "doc_id", "quality").where("quality = 1")
    rows = docs(spark, d).join(chosen, "doc_id", "left_semi").select(F.explode(F.array_distinct("words")).alias("term"))
    return rows.where(F.col("term").isin(FACETS)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT item_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+#.-]*[a-z0-9+#]|[a-z0-9]'), lambda w: len(w) >= 3 AND NOT list_contains({sql_list(T.IDEA_STOP_WORDS)}, w)),
lambda w: CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND len(w) > 3 THEN w[:-2] ELSE w END))) AS terms FROM benchmark), c AS (SELECT {sql_list(['thing', 'ering', 'onst', 'there', 'that'])} AS c)
SELECT item_id, CAST(len(terms) AS INT) AS n_terms, round(CASE WHEN len(terms) = 0 THEN 0 ELSE len(list_filter(terms, lambda t: list_contains(c, t) OR len(list_filter(c, lambda x: len(x) >= 4 AND starts_with(t, x))) > 0)) / len(terms) END, 6) AS overlap FROM t, c""")
def cliche_overlap(spark, d):
    terms = T.idea_terms("text")
    cliches = F.array(*(F.lit(w) for w in ("thing", "ering", "onst", "there", "that")))
    return table(spark, d, "benchmark").select("item_id", F.size(terms).alias("n_terms"), F.round(T.cliche_overlap(terms, cliches), 6).alias("overlap"))
