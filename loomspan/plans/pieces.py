"""Small library functions on the driver's tables: terms, cells, seeded requests, made-up cases, bundles, split summaries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomspan.functions import calls, numbers, patches, tables, text
from loomspan.operators import generation, ordering as o, pairs, splits
from loomspan.operators.summaries import r6
from loomspan.plans.registry import query
from loomspan.plans.repairs import FAILURES, PADDED, _failures
from loomspan.shared import cut


def _listed(words):
    return F.array_join(F.array_sort(words), " ")


_TERMS = "list_distinct(list_transform(list_filter(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9_./:-]*'), lambda w: length(w) >= 3), lambda w: lower(w)))"
_PIECES = "list_distinct(list_concat({0}, list_filter(flatten(list_transform({0}, lambda w: regexp_split_to_array(w, '[^A-Za-z0-9]+|_'))), lambda w: length(w) >= 3)))"


@query(f"SELECT page_id, array_to_string(list_sort({_PIECES.format(_TERMS.format('url'))}), ' ') AS terms FROM pages")
def identifier_terms(t):
    return t.pages.select("page_id", _listed(text.identifier_terms(F.col("url"))).alias("terms"))


@query(f"""
WITH d AS (SELECT p_partkey, {_TERMS.format("p_name || ' query'")} AS a, {_PIECES.format(_TERMS.format("replace(p_type, ' ', '_') || ' the_value'"))} AS b FROM part)
SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(list_concat(a, b, [{", ".join(f"'{w}'" for w in text.TYPE_WORDS)}])), lambda w: NOT list_contains([{", ".join(f"'{w}'" for w in text.STOP_TERMS)}], w))), ' ') AS terms FROM d""")
def forbidden_terms(t):
    """Terms that padding must not contain."""
    plain = text.meaningful_terms(F.concat("p_name", F.lit(" query")))
    names = text.identifier_terms(F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(" the_value")))
    return t.part.select("p_partkey", _listed(text.forbidden_terms(plain, names)).alias("terms"))


@query("""
SELECT event_id, coalesce(printf('%.4f', CASE WHEN event_type <> 'error' THEN value END), 'NA') AS cell, round_even(value, 0)::BIGINT AS whole,
  CASE WHEN contains(event_type, 'r') THEN '"it''s ' || event_type || '"' ELSE chr(39) || event_type || chr(39) END AS quoted,
  CASE WHEN event_id % 3 = 0 THEN ',' ELSE event_type END AS shown FROM events""")
def report_cells(t):
    """Cells of reports: fixed places or NA, ties to even, quoted text, accepted values without blanks unless all are."""
    word = F.when(F.contains("event_type", F.lit("r")), F.concat(F.lit("it's "), "event_type")).otherwise(F.col("event_type"))
    accepted = F.array(F.lit(""), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")))
    cell = text.fixed4(F.when(F.col("event_type") != "error", F.col("value")))
    return t.events.select("event_id", cell.alias("cell"), numbers.half_even(F.col("value")).alias("whole"), text.repr_text(word).alias("quoted"), F.array_join(text.shown_values(accepted), ",").alias("shown"))


@query("""
WITH r AS (SELECT doc_id, unnest(range(0, 16, 5)) AS i FROM labels)
SELECT doc_id, i::INT AS "offset", least(5, 16 - i)::INT AS size, (('0x' || substr(sha256('20260630:' || doc_id || ':sample:' || i), 1, 16))::UBIGINT)::VARCHAR AS seed FROM r""")
def seeded_requests(t):
    """Sixteen samples an episode in batches of five, each with its own seed of 64 bits."""
    rows = generation.requests(t.labels.select("doc_id"), "doc_id", o.SPLIT_SEED, "sample", 16, 5)
    return rows.select("doc_id", "offset", "size", F.col("seed").cast("string").alias("seed"))


@query("SELECT doc_id, (('0x' || substr(sha256('20260630:' || doc_id), 1, 16))::UBIGINT)::VARCHAR AS number FROM labels")
def stable_int_64(t):
    return t.labels.select("doc_id", o.stable_int(o.SPLIT_SEED, F.col("doc_id"), digits=16).cast("string").alias("number"))


@query("""
WITH s AS (SELECT doc_id, i, (doc_id * 7 + i * i) % 5 = 0 AS ok FROM labels, (SELECT unnest(range(0, 16)) AS i))
SELECT doc_id, count(*) FILTER (ok) AS hits, count(*) AS sample_count, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (ok), '') AS successful FROM s GROUP BY doc_id""")
def pass_records(t):
    """Hits of sixteen samples an episode, and which they are."""
    samples = t.labels.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("sample_index"))
    samples = samples.withColumn("success", (F.col("doc_id") * 7 + F.col("sample_index") * F.col("sample_index")) % 5 == 0)
    return generation.pass_records(samples, "doc_id").withColumn("successful", F.array_join("successful", ","))


@query("""
SELECT event_id, '{"arguments": {"k": ' || ((props->>'k')::INT + 1) || ', "tag": "x"}, "name": "' || event_type || '"}' AS wrong,
  '{"arguments": {"k": ' || (props->>'k') || ', "tag": "x"}, "name": "' || CASE WHEN event_type = 'view' THEN 'view__wrong' ELSE 'view' END || '"}' AS other FROM events""")
def wrong_cases(t):
    """A call with a wrong argument, and one of another function of its pool."""
    call = F.concat(F.lit('{"name": "'), "event_type", F.lit('", "arguments": {"k": '), F.get_json_object("props", "$.k"), F.lit(', "tag": "x"}}'))
    wrong = calls.text_udf(lambda s: calls.wrong_arguments(calls.call_from(json.loads(s))).canonical(), "string", None)
    other = calls.text_udf(lambda s: calls.wrong_function(calls.call_from(json.loads(s)), ["view"]).canonical(), "string", None)
    return t.events.select("event_id", wrong(call).alias("wrong"), other(call).alias("other"))


@query(f"""
WITH {FAILURES} SELECT episode_id, CASE WHEN router THEN 'Choose the candidate function whose description best matches the user intent.'
    ELSE 'Fill every required parameter with the value and type indicated by the query and schema.' END AS repair_rule, query AS user_query,
  CASE WHEN router THEN 'read_any' END AS model_selected, CASE WHEN router THEN name END AS gt_function, CASE WHEN NOT router THEN name END AS function_name,
  CASE WHEN NOT router THEN 'k' END AS parameter, CASE WHEN NOT router THEN got::VARCHAR END AS predicted, CASE WHEN router THEN 4 WHEN dated THEN 2 ELSE 1 END AS n_units FROM u""")
def information_bundle(t):
    """Each failure's bundle with the repair rule of its class."""
    get = lambda path: F.get_json_object("bundle", path)
    rows = patches.bundles(_failures(t).select("episode_id", "record"))
    return rows.select(
        "episode_id", get("$.repair_rule").alias("repair_rule"), get("$.user_query").alias("user_query"), get("$.model_selected").alias("model_selected"), get("$.gt_function").alias("gt_function"),
        get("$.function_name").alias("function_name"), get("$.parameters[0].name").alias("parameter"), get("$.predicted_arguments.k").alias("predicted"), F.json_array_length(get("$.iu_ids")).alias("n_units"),
    )


@query(f"""
WITH {FAILURES} SELECT episode_id, 1 AS place, 'IU-intent' AS iu_id, 'intent' AS kind FROM u WHERE router UNION ALL SELECT episode_id, 2, 'IU-fn-read_any', 'candidate_function' FROM u WHERE router
UNION ALL SELECT episode_id, 3, 'IU-fn-' || name, 'candidate_function' FROM u WHERE router UNION ALL SELECT episode_id, 4, 'IU-match', 'match' FROM u WHERE router
UNION ALL SELECT episode_id, 1, 'IU-param-k', 'parameter' FROM u WHERE NOT router UNION ALL SELECT episode_id, 2, 'IU-format-k', 'format' FROM u WHERE NOT router AND dated""")
def unit_rows(t):
    """A row for each information unit, by a lateral join."""
    return tables.information_units(_failures(t).select("episode_id", "record")).select("episode_id", "place", "iu_id", "kind")


@query(f"""
WITH {FAILURES}, {PADDED}, k AS (SELECT *, row_number() OVER (PARTITION BY router ORDER BY episode_id) AS i FROM t1),
l AS (SELECT episode_id, row_number() OVER (ORDER BY router DESC, episode_id) AS j FROM k WHERE i > 2),
c AS (SELECT episode_id FROM k WHERE i <= 2 UNION ALL SELECT episode_id FROM l WHERE j <= 10 - (SELECT count(*) FROM k WHERE i <= 2))
SELECT episode_id, CASE WHEN router THEN 'router_fail' ELSE 'validator_fail' END AS failure_class, struct_tokens, nl_tokens, p1 AS padded_tokens,
  p1 BETWEEN struct_tokens * 0.95 AND struct_tokens * 1.05 AS in_tolerance, true AS padding_without_information FROM k JOIN c USING (episode_id)""")
def pair_probe(t):
    """Ten failures, two or more of either class, with the token counts of their patches; an error unless all pairs hold."""
    made = cut(pairs.pairs(pairs.choose(_failures(t).select("episode_id", "failure_class", "record"), 10, 2)))
    pairs.assert_paired(made, 10, 2)
    return made.select("episode_id", "failure_class", "struct_tokens", "nl_tokens", "padded_tokens", "in_tolerance", "padding_without_information")


def _loaded(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    truth = F.concat(F.lit('{"read_'), "lang", F.lit('": {"k": ['), "toxic", F.lit("]}}"))
    return rows.select(
        "doc_id", F.when(F.col("quality") == 1, "multiple").otherwise("simple").alias("split"), F.col("lang").alias("category"),
        F.when(F.col("toxic") == 0, F.col("source")).alias("query"), F.when(F.col("quality") == 1, 2 + F.col("doc_id") % 4).otherwise(1).alias("pool_size"), truth.alias("ground_truth"),
    )


_LOADED = "l AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'multiple' ELSE 'simple' END AS split, lang AS category, toxic, CASE WHEN quality = 1 THEN 2 + doc_id % 4 ELSE 1 END AS pool FROM labels JOIN documents USING (doc_id))"


@query(f"""
WITH {_LOADED} SELECT split, count(*) AS n_episodes, min(pool) AS pool_min, max(pool) AS pool_max, round(avg(pool), 6) AS pool_mean, count(category) AS n_category, count(*) FILTER (toxic = 0) AS n_query FROM l GROUP BY split""")
def split_summary(t):
    return splits.summary(_loaded(t), ["category", "query"]).withColumn("pool_mean", r6(F.col("pool_mean")))


@query(f"WITH {_LOADED} SELECT split, category, count(*) AS n_episodes FROM l GROUP BY split, category")
def split_categories(t):
    return splits.categories(_loaded(t))


@query(f"WITH {_LOADED} SELECT split, true AS known_correct, false AS known_wrong FROM l GROUP BY split")
def self_check(t):
    """The verifier takes a split's first right call and refuses a wrong one; every split is complete."""
    rows = _loaded(t)
    splits.assert_usable(rows, ["category", "ground_truth"], "doc_id", {"multiple": 2}, {"simple": 1})
    return splits.self_check(rows, "doc_id")
