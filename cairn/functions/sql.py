"""The engine's functions under SQL names: ``register(spark)`` makes them temporary functions of a session, so queries can be written in SQL alone."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Sentences with the blanks behind them, as an SQL expression of ``text``, and the test of one: those of Unicode blanks only don't count.
SENTENCES = r"regexp_extract_all(text, '[^.!?]*[.!?]+[\\t\\n\\f\\r ]*|[^.!?]+$', 0)"
IS_SENTENCE = r"RLIKE '[^\\p{Zs}]'"
#: SQL functions: name, parameters, type, body. They are macros that the optimiser inlines.
SCALARS = {
    "cairn_words": ("text STRING", "ARRAY<STRING>", "coalesce(regexp_extract_all(lower(text), '[a-z0-9]+', 0), array())"),
    "cairn_host": ("url STRING", "STRING", r"regexp_replace(lower(translate(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]+)', 1), 'İΣ', 'iσ')), '^www\\.', '')"),  # one letter for each
    "cairn_squeeze": ("text STRING", "STRING", r"trim(regexp_replace(text, '\\s+', ' '))"),
    "cairn_idf": ("n BIGINT, df BIGINT", "DOUBLE", "CASE WHEN n > 0 THEN ln((n + 1) / (greatest(0, df) + 1)) ELSE 0 END"),
    "cairn_rarity": ("df BIGINT, cap BIGINT", "DOUBLE", "greatest(0, least(1, 1 - ln(1 + greatest(0, df)) / ln(1 + cap)))"),
    "cairn_share_left": ("n BIGINT, cap BIGINT", "DOUBLE", "1 - ln(1 + n) / ln(1 + cap)"),  # rarity on an open scale: below 0 above the cap
    "cairn_sentence_count": ("text STRING", "BIGINT", f"array_size(filter({SENTENCES}, s -> s {IS_SENTENCE}))"),
    "cairn_dkw": ("n BIGINT", "DOUBLE", "CASE WHEN n > 0 THEN least(1, sqrt(ln(40) / (2 * n))) ELSE 1 END"),
    "cairn_match": ("similarity DOUBLE", "DOUBLE", "1 / (1 + exp(-(similarity - 0.156) * ln(9) / (0.365 - 0.156)))"),
}
#: Table functions: name, parameters, columns, body.
TABLES = {
    "cairn_sentences": ("text STRING", "place INT, sentence STRING", f"SELECT pos + 1, trim(col) FROM posexplode({SENTENCES}) WHERE col {IS_SENTENCE}"),
}


def register(spark: SparkSession) -> list[str]:
    """Register all functions in the session; returns their names."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (parameters, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    return [*SCALARS, *TABLES]
