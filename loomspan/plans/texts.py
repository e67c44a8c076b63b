"""Text, template and parity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import text as x
from loomspan.operators.ordering import hash_of
from loomspan.operators.summaries import r6
from loomspan.plans.registry import query

WORDISH = r"[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s]"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{WORDISH}'))::BIGINT AS n_tokens FROM documents")
def token_count(t):
    return t.documents.select("doc_id", x.token_count(F.col("text")).alias("n_tokens"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS n_words FROM documents")
def word_count(t):
    return t.documents.select("doc_id", x.word_count(F.col("text")).alias("n_words"))


TERMS = "list_distinct(list_transform(list_filter(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9_./:-]*'), lambda w: length(w) >= 3), lambda w: lower(w)))"


@query(f"SELECT doc_id, len({TERMS.format('text')})::BIGINT AS n_terms FROM documents")
def meaningful_terms(t):
    return t.documents.select("doc_id", F.size(x.meaningful_terms(F.col("text"))).cast("long").alias("n_terms"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)\b(format|iso|yyyy|hh:mm|date|time|enum)\b') AS needs_format FROM documents")
def format_requirement(t):
    return t.documents.select("doc_id", x.needs_format(F.col("text")).alias("needs_format"))


@query(f"""
WITH b AS (SELECT DISTINCT unnest({TERMS.format('text')}) AS term FROM benchmark), d AS (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents)
SELECT doc_id, count(*) AS n_shared FROM d JOIN b ON b.term = d.term GROUP BY doc_id HAVING count(*) >= 20""")
def leak_terms(t):
    """Documents that share 20 distinct terms or more with the held-out texts."""
    held = t.benchmark.select(F.explode(x.meaningful_terms(F.col("text"))).alias("term")).distinct()
    terms = t.documents.select("doc_id", F.explode(x.meaningful_terms(F.col("text"))).alias("term"))
    return terms.join(held, "term", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_shared")).filter("n_shared >= 20")


@query(f"""
WITH d AS (SELECT lang, len(regexp_extract_all(text, '{WORDISH}')) AS n FROM documents) SELECT lang, count(*) AS n_rows, round(avg(n), 6) AS mean_tokens, sum(n)::BIGINT AS n_tokens FROM d GROUP BY lang""")
def context_cost(t):
    rows = t.documents.select("lang", x.token_count(F.col("text")).alias("n"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_rows"), r6(F.avg("n")).alias("mean_tokens"), F.sum("n").alias("n_tokens"))


@query("""
WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word, unnest(range(0, len(string_split(text, ' ')))) AS i FROM benchmark)
SELECT item_id, string_agg(word, ' ' ORDER BY sha256('20260630:' || item_id || ':' || i), i) AS placebo FROM w GROUP BY item_id""")
def placebo_shuffle(t):
    """The words of each held-out text in seeded hash order."""
    words = t.benchmark.select("item_id", F.posexplode(F.split("text", " ")).alias("i", "word"))
    order = F.struct(hash_of(20260630, F.col("item_id"), F.col("i")).alias("h"), "i", "word")
    made = words.groupBy("item_id").agg(F.array_sort(F.collect_list(order)).alias("words"))
    return made.select("item_id", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("placebo"))
