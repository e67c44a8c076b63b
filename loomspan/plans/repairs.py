"""Information units, patches, relevance, prompts and evolution on failure records made from the labelled documents.

A document of quality 0 is a failed call: it wants ``read_<lang>(k=<id % 7>)``.
Every third one chose another function, the others a wrong ``k``.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from loomspan.functions import calls, patches as p
from loomspan.functions.text import leaks_term, meaningful_terms
from loomspan.operators import datasets, decouple, evolution, ordering as o
from loomspan.operators.generation import generate
from loomspan.operators.summaries import r6, ratio
from loomspan.plans.registry import query
from loomspan.plans.samples import SPLIT, arg_k

WORDISH = r"[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s]"


def _function(name, reads, note):
    return F.concat(
        F.lit('{"name": "'), name, F.lit('", "description": "Read a text in '), reads,
        F.lit('", "parameters": {"type": "dict", "required": ["k"], "properties": {"k": {"type": "integer", "description": "'), note, F.lit('"}}}}'),
    )


def _failures(t, kinds: int = 1):
    """episode_id, failure_class, query, functions (JSON) and record (JSON); each language has as many functions as ``kinds``."""
    rows = t.labels.filter("quality = 0").join(t.documents.select("doc_id", "lang"), "doc_id")
    k, router = F.col("doc_id") % 7, F.col("doc_id") % 3 == 0
    name = F.concat(F.lit("read_"), "lang", *([F.lit("_"), (F.col("doc_id") % kinds).cast("string")] if kinds > 1 else []))
    note = F.when(F.col("doc_id") % 2 == 1, "date of the text").otherwise("number of the text")
    query_of = F.concat(F.lit("Find "), "lang", F.lit(" text number "), F.col("doc_id").cast("string"))
    functions = F.concat(F.lit("["), _function(F.lit("read_any"), F.lit("any language"), note), F.lit(", "), _function(name, F.col("lang"), note), F.lit("]"))
    label = F.when(router, "router_fail").otherwise("validator_fail")
    chosen = F.when(router, F.lit("read_any")).otherwise(name)
    rows = rows.select(
        "doc_id",
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("episode_id"),
        label.alias("failure_class"),
        query_of.alias("query"),
        functions.alias("functions"),
        name.alias("name"),
        chosen.alias("chosen"),
        k.cast("string").alias("k"),
        F.when(router, k).otherwise(k + 1).cast("string").alias("got"),
    )
    record = F.concat(
        F.lit('{"episode_id": "'), "episode_id", F.lit('", "failure_class": "'), "failure_class", F.lit('", "query": "'), "query", F.lit('", "function_pool": '), "functions",
        F.lit(', "ground_truth_call": {"name": "'), "name", F.lit('", "accepted_arguments": {"k": ['), "k", F.lit(', ""]}}, "predicted_call": {"name": "'), "chosen",
        F.lit('", "arguments": {"k": '), "got", F.lit("}}}"),
    )
    return rows.withColumn("record", record)


# The same records in SQL; ~ stands for a line's end.
FAILURES = """r AS (
  SELECT doc_id, 'd' || doc_id AS episode_id, doc_id % 3 = 0 AS router, 'Find ' || lang || ' text number ' || doc_id AS query, lang, 'read_' || lang AS name,
         doc_id % 7 AS k, doc_id % 7 + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS got, doc_id % 2 = 1 AS dated,
         CASE WHEN doc_id % 2 = 1 THEN 'date of the text' ELSE 'number of the text' END AS note FROM labels JOIN documents USING (doc_id) WHERE quality = 0),
u AS (SELECT *, 'Extract k as type integer using the query and schema; accepted value(s): [' || k || ']; predicted value: ' || got || '.' AS rule,
         'k must follow type integer; schema note: ' || note AS requirement FROM r),
x AS (SELECT *, replace(CASE WHEN router THEN '[STEP 1] User wants to:~  ' || query || '~[STEP 2] Candidate functions and what each does:~  - name: read_any | does: Read a text in any language~  - name: '
    || name || ' | does: Read a text in ' || lang || '~[STEP 3] Model selected: read_any~[STEP 4] Best match: ' || name || '~[WHY] The best function is the one whose description matches the user intent.'
  ELSE '[FUNCTION] ' || name || '~[QUERY] ' || query || '~[PARAMETERS]~[PARAM 1] name: k | type: integer | description: ' || note || ' | accepted: [' || k || '] | predicted: ' || got || ' | rule: ' || rule
    || CASE WHEN dated THEN '~[FORMAT REQUIREMENTS]~[FORMAT] parameter: k | requirement: ' || requirement ELSE '' END END, '~', chr(10)) AS struct_text,
  CASE WHEN router THEN 'For the user query ''' || query || ''', compare these candidate functions: read_any does Read a text in any language; ' || name || ' does Read a text in ' || lang
    || '. The model selected read_any, while the best matching function is ' || name || ' because The best function is the one whose description matches the user intent.'
  ELSE 'For function ' || name || ' and query ''' || query || ''', extract the parameters as follows: k has type integer, description ''' || note || ''', accepted value [' || k || '], predicted value ' || got
    || ', and rule ' || rule || '.' || CASE WHEN dated THEN ' Format requirement for k: ' || requirement || '.' ELSE '' END END AS nl_text FROM u)"""
COUNTED = f"n AS (SELECT *, len(regexp_extract_all(struct_text, '{WORDISH}'))::BIGINT AS struct_tokens, len(regexp_extract_all(nl_text, '{WORDISH}'))::BIGINT AS nl_tokens FROM x)"


def _patches(t):
    return p.materialize(_failures(t))


def _by_family(t):
    """One row per failure with its patches' texts, token counts and unit ids."""
    of = lambda family, column: F.max(F.when(F.col("family") == family, F.col(column)))
    columns = [of(f, c).alias(f"{a}_{b}") for f, a in zip(p.FAMILIES, ("struct", "nl", "padded")) for c, b in (("patch_text", "text"), ("token_count", "tokens"), ("iu_ids", "ids"))]
    return _patches(t).groupBy(F.col("trigger_episode_id").alias("episode_id"), "component").agg(*columns)


@query(f"""
WITH {FAILURES} SELECT episode_id, CASE WHEN router THEN 'IU-intent,IU-fn-read_any,IU-fn-' || name || ',IU-match' WHEN dated THEN 'IU-param-k,IU-format-k' ELSE 'IU-param-k' END AS units FROM u""")
def iu_set(t):
    """The information units of each failure, in order."""
    run = lambda: lambda batch: batch.assign(units=[",".join(u.id for u in p.units(json.loads(r))) for r in batch["record"]])[["episode_id", "units"]]
    return generate(_failures(t).select("episode_id", "record"), run, "episode_id string, units string")


@query(f"""
WITH {FAILURES} SELECT episode_id, 'k' AS name, 'integer' AS type, note AS description, '[' || k || ']' AS accepted, got::VARCHAR AS predicted, rule,
  CASE WHEN dated THEN requirement ELSE '' END AS requirement FROM u WHERE NOT router""")
def patch_parameters(t):
    """Type, description, accepted and predicted value of each parameter of the validator failures."""

    def rows(batch):
        made = batch.assign(rows=[p.parameters(json.loads(r)) for r in batch["record"]]).explode("rows").dropna(subset=["rows"])
        for column, key in (("name", "name"), ("type", "type"), ("description", "description"), ("rule", "rule")):
            made[column] = [r[key] for r in made["rows"]]
        made["accepted"] = [str(r["accepted_values"]) for r in made["rows"]]
        made["predicted"] = [str(r["predicted_value"]) for r in made["rows"]]
        made["requirement"] = [r.get("requirement", "") for r in made["rows"]]
        return made[["episode_id", "name", "type", "description", "accepted", "predicted", "rule", "requirement"]]

    failures = _failures(t).filter("failure_class = 'validator_fail'").select("episode_id", "record")
    return generate(failures, lambda: rows, "episode_id string, name string, type string, description string, accepted string, predicted string, rule string, requirement string")


@query(f"WITH {FAILURES} SELECT episode_id, struct_text, nl_text FROM x")
def render_patch(t):
    """Structured and prose patches of each failure."""
    return _by_family(t).select("episode_id", "struct_text", "nl_text")


def _greedy(sizes) -> str:
    """SQL of the token count after padding by units of these sizes, the largest first."""
    parts, last = [], "nl_tokens"
    for s in sizes:
        parts.append(f"t{s} AS (SELECT *, {last} + CASE WHEN {last} < low THEN {s} * greatest(0, least(ceil((low - {last}) / {s}.0)::BIGINT, (high - {last}) // {s})) ELSE 0 END AS p{s} FROM {parts[-1].split()[0] if parts else 'b'})")
        last = f"p{s}"
    return ", ".join(parts)


PADDED = f"""{COUNTED}, b AS (SELECT *, ceil(struct_tokens * 0.95)::BIGINT AS low, floor(struct_tokens * 1.05)::BIGINT AS high FROM n), {_greedy((7, 6, 5, 2, 1))}"""


@query(f"WITH {FAILURES}, {PADDED} SELECT episode_id, p1 AS n_tokens FROM t1")
def greedy_padding(t):
    """Token counts of the prose patches padded towards the structured ones."""
    return _by_family(t).select("episode_id", F.col("padded_tokens").cast("long").alias("n_tokens"))


@query(f"WITH {FAILURES}, {PADDED} SELECT episode_id, true AS same_units, p1 BETWEEN struct_tokens * 0.95 AND struct_tokens * 1.05 AS in_tolerance FROM t1")
def parity_check(t):
    """Equal unit lists in all families, and the padded text's length within the tolerance."""
    rows = _by_family(t)
    same = (F.col("struct_ids") == F.col("nl_ids")) & (F.col("nl_ids") == F.col("padded_ids"))
    return rows.select("episode_id", same.alias("same_units"), F.col("padded_tokens").between(F.col("struct_tokens") * 0.95, F.col("struct_tokens") * 1.05).alias("in_tolerance"))


@query(f"WITH {FAILURES}, {COUNTED} SELECT episode_id, struct_tokens, nl_tokens, round(coalesce(struct_tokens / nullif(nl_tokens, 0), 0), 6) AS ratio FROM n")
def pair_ratios(t):
    rows = _by_family(t).select("episode_id", F.col("struct_tokens").cast("long").alias("struct_tokens"), F.col("nl_tokens").cast("long").alias("nl_tokens"))
    return rows.withColumn("ratio", r6(ratio(F.col("struct_tokens"), F.col("nl_tokens"))))


@query(f"""
WITH {FAILURES}, {COUNTED}, q AS (SELECT CASE WHEN router THEN 'router' ELSE 'validator' END AS class, struct_tokens, nl_tokens, struct_tokens / nl_tokens AS ratio FROM n)
SELECT coalesce(class, 'all') AS class, count(*) AS n, round(avg(struct_tokens), 6) AS mean_struct, round(avg(nl_tokens), 6) AS mean_nl, round(avg(ratio), 6) AS mean_ratio,
  round(stddev_pop(ratio), 6) AS std_ratio FROM q GROUP BY ROLLUP (class)""")
def pair_summary(t):
    rows = _by_family(t).withColumn("ratio", ratio(F.col("struct_tokens"), F.col("nl_tokens"))).withColumnRenamed("component", "class")
    return rows.rollup("class").agg(
        F.count("*").alias("n"),
        r6(F.avg("struct_tokens")).alias("mean_struct"),
        r6(F.avg("nl_tokens")).alias("mean_nl"),
        r6(F.avg("ratio")).alias("mean_ratio"),
        r6(F.stddev_pop("ratio")).alias("std_ratio"),
    ).fillna("all", ["class"])


_DOC = """'{"name": "' || name || '", "description": "Read a text in ' || reads || '", "parameters": {"type": "dict", "required": ["k"], "properties": {"k": {"type": "integer", "description": "' || note || '"}}}}'"""


@query(f"""
WITH {FAILURES}, d AS (SELECT x.*, '[' || {_DOC.replace("' || name || '", "read_any").replace("' || reads || '", "any language")} || ', ' || {_DOC.replace("reads", "lang")} || ']' AS functions FROM x),
y AS (SELECT episode_id, 'Patches:' || chr(10) || '[PATCH 1] ' || struct_text || chr(10) || chr(10) || '[PATCH 2] ' || nl_text || chr(10) || chr(10) || 'Query: ' || query || chr(10) || 'Functions: ' || functions || chr(10) || 'Call:' AS prompt FROM d)
SELECT episode_id, length(prompt)::BIGINT AS n_chars, sha256(prompt) AS prompt_sha256 FROM y""")
def build_prompt(t):
    """A prompt with two patches, the query and the function documents."""
    rows = _by_family(t).join(_failures(t).select("episode_id", "query", "functions"), "episode_id")
    made = rows.select("episode_id", p.prompt(F.array("struct_text", "nl_text"), F.col("query"), F.col("functions")).alias("prompt"))
    return made.select("episode_id", F.length("prompt").cast("long").alias("n_chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


@query(f"""
WITH {SPLIT}, {FAILURES}, h AS (SELECT r.*, part FROM r JOIN split USING (doc_id)),
c AS (SELECT name, count(*) AS n FROM h WHERE part = 'train' GROUP BY name)
SELECT episode_id, coalesce(n, 0) AS n_relevant FROM h LEFT JOIN c USING (name) WHERE part = 'held_out'""")
def patch_relevance(t):
    """Structured patches of the training failures that concern each held-out failure."""
    parts = o.split_by_hash(t.labels, "doc_id").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("episode_id"), "part")
    failures = _failures(t).join(parts, "episode_id")
    made = p.materialize(failures.filter("part = 'train'")).filter("family = 'STRUCT'")
    held = evolution.with_keys(failures.filter("part = 'held_out'"))
    return p.relevant_counts(made, held)


@query("""
WITH e AS (SELECT user_id, event_type, (props->>'k')::INT % 8 AS k, value FROM events),
c AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY user_id, event_type),
a AS (SELECT user_id, first(event_type ORDER BY n DESC, event_type) AS arm FROM c GROUP BY user_id),
u AS (SELECT a.user_id, a.arm, coalesce(list_distinct(list(k) FILTER (value > 100)), []) AS ks FROM a JOIN e ON e.user_id = a.user_id GROUP BY a.user_id, a.arm)
SELECT x.user_id, count(y.user_id) AS n_relevant FROM u x LEFT JOIN u y ON x.arm = y.arm AND x.user_id <> y.user_id AND len(list_intersect(x.ks, y.ks)) > 0 GROUP BY x.user_id""")
def patch_relevance_join(t):
    """How many users' parameters overlap with a user's of the same arm, by classes of equal parameter sets."""
    rows = t.events.select("user_id", "event_type", (arg_k() % 8).alias("k"), "value")
    counts = rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    arms = counts.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("arm"))
    sets = rows.groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(F.col("value") > 100, F.col("k")))).alias("ks"))
    found = p.overlap_counts(arms.join(sets, "user_id"), ["arm"], "ks")
    own = (F.size("ks") > 0).cast("long")
    return found.select("user_id", (F.col("n_met") - own).alias("n_relevant"))


@query("""
WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) >= 3)) AS words FROM benchmark)
SELECT item_id, list_contains(words, 'the') OR list_contains(words, 'and') AS leaks FROM t""")
def leak_whole_words(t):
    """Whether a held-out text has one of two terms as a whole word."""
    return t.benchmark.select("item_id", leaks_term(F.col("text"), F.array(F.lit("the"), F.lit("and"))).alias("leaks"))


@query("""SELECT event_id, event_type || '(k=' || (props->>'k') || ', tag=''x'', heavy=' || CASE WHEN value > 8 THEN 'True' ELSE 'False' END || ')' AS call FROM events""")
def render_call(t):
    """Calls as source text, values quoted as Python does."""
    call = F.concat(
        F.lit('{"name": "'), "event_type", F.lit('", "arguments": {"k": '), arg_k().cast("string"), F.lit(', "tag": "x", "heavy": '),
        F.when(F.col("value") > 8, "true").otherwise("false"), F.lit("}}"),
    )
    shown = calls.text_udf(lambda s: calls.call_from(json.loads(s)).source(), "string", None)
    return t.events.select("event_id", shown(call).alias("call"))


def stub_model():
    """A deterministic model: right for two prompts of three, by their hash."""

    def run(prompt: str, failure: dict) -> str:
        if int(hashlib.sha256(prompt.encode()).hexdigest()[:8], 16) % 3:
            truth = failure["ground_truth_call"]
            return json.dumps({"name": truth["name"], "arguments": calls.first_arguments(truth)})
        return "no call"

    return run


@query()
def evolution_run(t):
    """Pass rates of every method and seed with a deterministic stub model; tests compare it with one plain loop."""
    rows = evolution.evolve(_failures(t, 60), [20260630, 20260701], stub_model).seed_rows
    return rows.select("seed", "method", "overall_n", "overall_pass", r6(F.col("overall_pass_rate")).alias("overall_pass_rate"), "router_n", "router_pass", "validator_n", "validator_pass")


@query(f"""
WITH {FAILURES} SELECT CASE WHEN router THEN 'router_fail' ELSE 'validator_fail' END AS failure_class, count(*) AS n, count(DISTINCT name) AS n_functions,
  count(*) FILTER (len({{terms}}) > 0) AS n_with_terms FROM r GROUP BY 1""".replace("{terms}", "list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z][a-z0-9_./:-]*'), lambda w: length(w) >= 3))"))
def failure_inventory(t):
    """Failures by class, with the functions they want and whether their queries hold terms."""
    rows = evolution.with_keys(_failures(t)).join(_failures(t).select("episode_id", "query"), "episode_id")
    return rows.groupBy("failure_class").agg(
        F.count("*").alias("n"), F.countDistinct("gt_name").alias("n_functions"), F.count_if(F.size(meaningful_terms(F.col("query"))) > 0).alias("n_with_terms")
    )


_ROWS = """SELECT 'd' || doc_id AS episode_id, '{0}' AS source, {1} AS sample_index, '{{"arguments": {{"k": ' || (doc_id % 7) || '}}, "name": "read_' || lang || '"}}' AS output FROM e"""


@query(f"""
WITH {SPLIT}, e AS (SELECT doc_id, lang, quality, part FROM split JOIN documents USING (doc_id)),
teacher AS ({_ROWS.format('teacher_t0', 'NULL::BIGINT')} WHERE part = 'train' AND quality = 0),
star AS ({_ROWS.format('star_pass16', 's')}, (SELECT unnest([0, 1])::BIGINT AS s) WHERE part = 'train' AND quality = 0 AND doc_id % 2 = 0),
replay AS ({_ROWS.format('replay_base_success', 'NULL::BIGINT')} WHERE quality = 1 AND part = 'train'),
n AS (SELECT (SELECT count(*) FROM teacher) AS t, (SELECT count(*) FROM star) AS s, (SELECT count(*) FROM replay) AS r),
size AS (SELECT r, least(t, CASE WHEN s > 0 THEN floor(s / 0.9)::BIGINT ELSE t END) AS m, s FROM n),
sizes AS (SELECT m, least(s, greatest(1, round_even(m * 0.8, 0)::BIGINT)) AS c, r FROM size),
p AS (
  SELECT 'main' AS dataset, *, row_number() OVER (ORDER BY sha256('20260702:main_core:' || episode_id || ':' || source || ':' || output), sample_index) AS i, (SELECT m FROM sizes) AS most FROM teacher
  UNION ALL SELECT 'star', *, row_number() OVER (ORDER BY sha256('20260702:star_core:' || episode_id || ':' || source || ':' || output), sample_index), (SELECT c FROM sizes) FROM star
  UNION ALL SELECT 'main', *, row_number() OVER (ORDER BY sha256('20260702:main_replay:' || episode_id || ':' || source || ':' || output), sample_index), (SELECT least(r, round_even(m * 0.5, 0)::BIGINT) FROM sizes) FROM replay
  UNION ALL SELECT 'star', *, row_number() OVER (ORDER BY sha256('20260702:star_replay:' || episode_id || ':' || source || ':' || output), sample_index), (SELECT least(r, round_even(c * 0.5, 0)::BIGINT) FROM sizes) FROM replay)
SELECT dataset, episode_id, source, sample_index, 'Query: Find ' || lang || ' text' || chr(10) || 'Functions: []' AS input, output FROM p JOIN e ON 'd' || e.doc_id = p.episode_id WHERE i <= most""")
def training_datasets(t):
    """Balanced training rows with replay, checked against held-out and validation ids."""
    rows = o.split_by_hash(t.labels, "doc_id").join(t.documents.select("doc_id", "lang"), "doc_id")
    call = F.concat(F.lit('{"name": "read_'), "lang", F.lit('", "arguments": {"k": '), (F.col("doc_id") % 7).cast("string"), F.lit("}}"))
    episodes = rows.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("episode_id"), "doc_id", "part", "quality",
        F.concat(F.lit("Find "), "lang", F.lit(" text")).alias("query"), F.lit("[]").alias("functions"), call.alias("call"),
    )
    template = "Query: {query}\nFunctions: {function_doc}"
    train = episodes.filter("part = 'train'")
    failed = train.filter("quality = 0")
    star = failed.filter("doc_id % 2 = 0").withColumn("sample_index", F.explode(F.array(F.lit(0), F.lit(1))))
    ids = lambda part: episodes.filter(F.col("part") == part).select("episode_id")
    made = datasets.build(
        datasets.training_rows(failed, template, "teacher_t0"),
        datasets.training_rows(star, template, "star_pass16"),
        datasets.training_rows(episodes.filter("quality = 1"), template, "replay_base_success", F.lit("replay")),
        {"held-out": ids("held_out"), "validation": ids("validation")},
        datasets.Plan(replay_ratio=0.5, star_ratio=0.8),
    )
    both = made.main.withColumn("dataset", F.lit("main")).unionByName(made.star.withColumn("dataset", F.lit("star")))
    return both.select("dataset", "episode_id", "source", "sample_index", "input", "output")


@query(f"""
WITH {FAILURES}, f AS (SELECT name, min(doc_id) AS first_id FROM r GROUP BY name),
o AS (SELECT 'read_any' AS name, CASE WHEN (SELECT router FROM r ORDER BY doc_id LIMIT 1) THEN 1 ELSE 2 END AS place, (SELECT min(doc_id) FROM r) AS first_id UNION ALL SELECT name, 0, first_id FROM f),
c AS (SELECT name, 'fn_' || lpad(row_number() OVER (ORDER BY first_id, place)::VARCHAR, 4, '0') AS code FROM o)
SELECT episode_id, c.code AS name, CASE WHEN router THEN (SELECT code FROM c WHERE name = 'read_any') ELSE c.code END AS chosen, 'field_0001' AS parameter,
  CASE WHEN router = (SELECT router FROM r ORDER BY doc_id LIMIT 1) THEN 'err_01' ELSE 'err_02' END AS label FROM r JOIN c ON c.name = r.name""")
def decouple_failures(t):
    """Failure records with codes for their names; an error unless the six invariants hold."""
    made = decouple.decouple(_failures(t).select("episode_id", "failure_class", "record", F.col("doc_id").alias("ord")), ("router", "validator"))
    get = lambda path: F.get_json_object("record", path)
    parameter = F.get(F.json_object_keys(get("$.ground_truth_call.accepted_arguments")), F.lit(0))
    return made.failures.select("episode_id", get("$.ground_truth_call.name").alias("name"), get("$.predicted_call.name").alias("chosen"), parameter.alias("parameter"), get("$.decoupled_failure_label").alias("label"))
