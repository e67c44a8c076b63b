"""State, array, verifier and composite queries."""

from __future__ import annotations

import json
import re

from pyspark.sql import Window as W, functions as F

from loomspan.functions import calls as c, tables
from loomspan.functions.drift import failure_class
from loomspan.functions.numbers import BUDGET_TIERS, cosine_rate, divergence, in_budget_tiers
from loomspan.functions.text import first_concrete as first_filled
from loomspan.operators import arena, loop, ordering as o
from loomspan.operators.summaries import r6
from loomspan.plans.registry import query
from loomspan.plans.samples import arg_k, SPLIT

def heavy():
    return F.col("value") > 8


@query("""
SELECT event_id, round(sum(value) OVER w, 4) AS total, round(sum(value) OVER w, 4) > 500 AS over_limit FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def budget_meter(t):
    total = F.round(F.sum("value").over(W.partitionBy("user_id").orderBy("event_id")), 4)
    return t.events.select("event_id", total.alias("total"), (total > 500).alias("over_limit"))


@query("""
WITH d AS (SELECT user_id, ts::DATE AS day, max((value > 60)::INT) AS ok FROM events GROUP BY 1, 2),
l AS (SELECT day, ok, coalesce(lag(ok) OVER (PARTITION BY user_id ORDER BY day), 0) AS old FROM d)
SELECT day::VARCHAR AS day, count(*) FILTER (ok > old) AS fixed, count(*) FILTER (ok < old) AS regressed, count(*) FILTER (ok > old) > 0 AND count(*) FILTER (ok < old) = 0 AS accepted FROM l GROUP BY day""")
def accept_rule(t):
    days = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max((F.col("value") > 60).cast("int")).alias("ok"))
    rows = days.withColumn("old", F.coalesce(F.lag("ok").over(W.partitionBy("user_id").orderBy("day")), F.lit(0)))
    out = rows.groupBy(F.col("day").cast("string").alias("day")).agg(F.count_if(F.col("ok") > F.col("old")).alias("fixed"), F.count_if(F.col("ok") < F.col("old")).alias("regressed"))
    return out.withColumn("accepted", loop.accepted(F.col("fixed"), F.col("regressed")))


@query(f"""
WITH {SPLIT}, d AS (SELECT s.*, source FROM split s JOIN documents USING (doc_id)), p AS (SELECT source, count(*) AS n FROM d WHERE part = 'train' AND quality = 0 GROUP BY source)
SELECT doc_id, coalesce(n, 0) AS n_patches, coalesce(n, 0) > 0 AND quality = 1 AS success FROM d LEFT JOIN p USING (source) WHERE part = 'held_out'""")
def heldout_eval(t):
    rows = o.split_by_hash(t.labels, "doc_id").join(t.documents.select("doc_id", "source"), "doc_id")
    patches = rows.filter("part = 'train' and quality = 0").select("source")
    return loop.evaluate(rows.filter("part = 'held_out'"), patches, "source", F.col("quality") == 1).select("doc_id", "n_patches", "success")


@query("""
WITH f AS (SELECT user_id, min(event_id) FILTER (value > 100) AS first FROM events GROUP BY user_id)
SELECT user_id, coalesce(first, -1) AS first, count(*) FILTER (first IS NULL OR event_id <= first) AS n_tried FROM events JOIN f USING (user_id) GROUP BY user_id, first""")
def oracle_first_success(t):
    out = loop.first_success(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", F.col("value") > 100)
    return out.withColumn("first", F.coalesce("first", F.lit(-1)))


USED = "e AS (SELECT event_id, 1 + (event_type = 'purchase')::INT AS calls, floor(value * 10)::BIGINT AS ms, length(props) * 3 AS tokens FROM events)"


def _used(t):
    calls = 1 + (F.col("event_type") == "purchase").cast("int")
    return t.events.select("event_id", calls.alias("calls"), F.floor(F.col("value") * 10).alias("ms"), (F.length("props") * 3).alias("tokens"))


def _over(a: int, b: int, c: int) -> str:
    return f"calls_upto > {a} OR ms_upto > {b} OR tokens_upto > {c}"


@query(f"""
WITH {USED}, r AS (SELECT *, sum(calls) OVER w AS calls_upto, sum(ms) OVER w AS ms_upto, sum(tokens) OVER w AS tokens_upto FROM e WINDOW w AS (ORDER BY event_id))
SELECT event_id, calls_upto::BIGINT AS calls_upto, ms_upto::BIGINT AS ms_upto, tokens_upto::BIGINT AS tokens_upto,
  {", ".join(f"{_over(*BUDGET_TIERS[tier])} AS over_{tier}" for tier in BUDGET_TIERS)} FROM r""")
def budget_totals(t):
    """Running calls, milliseconds and tokens over all events, and which tiers' caps they are over."""
    out = in_budget_tiers(_used(t), ["event_id"], "calls", "ms", "tokens")
    return out.select("event_id", "calls_upto", "ms_upto", "tokens_upto", *(f"over_{tier}" for tier in BUDGET_TIERS))


@query(f"""
WITH {USED}, r AS (SELECT *, sum(calls) OVER w AS calls_upto, sum(ms) OVER w AS ms_upto, sum(tokens) OVER w AS tokens_upto FROM e WINDOW w AS (ORDER BY event_id))
{" UNION ALL ".join(f"SELECT '{tier}' AS tier, min(event_id) AS first_over, count(*) AS n_over FROM r WHERE {_over(*BUDGET_TIERS[tier])}" for tier in BUDGET_TIERS)}""")
def budget_first_over(t):
    """The first event over each tier's caps, and how many are."""
    out = in_budget_tiers(_used(t), ["event_id"], "calls", "ms", "tokens")
    over = [F.when(F.col(f"over_{tier}"), F.lit(tier)) for tier in BUDGET_TIERS]
    hits = out.select("event_id", F.explode(F.array_compact(F.array(*over))).alias("tier")).groupBy("tier").agg(F.min("event_id").alias("first_over"), F.count("*").alias("n_over"))
    tiers = t.spark.createDataFrame([(tier,) for tier in BUDGET_TIERS], "tier string")
    return tiers.join(hits, "tier", "left").na.fill(0, ["n_over"])


def _pool(t):
    """Per user: arms in order of appearance (one entry an event arm, at most five)."""
    firsts = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"), F.min_by("value", "event_id").alias("value"))
    return firsts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_type", "value"))).alias("pool"))


POOL = "f AS (SELECT user_id, event_type, min(event_id) AS pos, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2)"


@query(f"WITH {POOL} SELECT user_id, coalesce(max(value) FILTER (event_type = 'click'), first(value ORDER BY pos)) AS schema_value FROM f GROUP BY user_id")
def schema_lookup(t):
    """The entry of the wanted name, else the first one."""
    hit = F.get(F.filter("pool", lambda f: f["event_type"] == "click"), F.lit(0))
    return _pool(t).select("user_id", F.coalesce(hit["value"], F.get("pool", F.lit(0))["value"]).alias("schema_value"))


@query(f"""
WITH {POOL} SELECT user_id, coalesce(first(event_type ORDER BY pos) FILTER (event_type <> 'click'), 'click__wrong') AS wrong FROM f GROUP BY user_id""")
def wrong_function_case(t):
    wrong = c.text_udf(lambda pool: c.wrong_function(c.Call("click"), json.loads(pool)).name, "string", None)
    names = F.to_json(F.transform("pool", lambda f: f["event_type"]))
    return _pool(t).select("user_id", wrong(names).alias("wrong"))


@query("SELECT doc_id, coalesce(list_filter(['', CASE WHEN n_chars % 2 = 0 THEN '' ELSE lang END, source], lambda v: v <> '')[1], '') AS value FROM documents")
def first_concrete(t):
    values = F.array(F.lit(""), F.when(F.col("n_chars") % 2 == 0, "").otherwise(F.col("lang")), F.col("source"))
    return t.documents.select("doc_id", F.coalesce(first_filled(values), F.lit("")).alias("value"))


def _cases(t):
    """Every event's call in the four cases, with the verifier's verdicts."""

    def run(text):
        truth = json.loads(text)
        right, made = c.Call(c.accepted_call(truth).name, c.first_arguments(truth)), []
        for name, change in c.CASES.items():
            call = change(right)
            router, validator, _ = c.verdict({"name": call.name, "arguments": call.arguments}, truth)
            made.append({"case": name, "name": call.name, "arg": call.arguments.get("k"), "router": router, "validator": validator})
        return json.dumps(made)

    truth = F.concat(F.lit('[{"'), F.col("event_type"), F.lit('": {"k": ['), arg_k().cast("string"), F.lit(', ""], "note": [""]}}]'))
    schema = "array<struct<case:string,name:string,arg:int,router:boolean,validator:boolean>>"
    return t.events.select("event_id", F.inline(F.from_json(c.text_udf(run, "string", None)(truth), schema)))


CASES_SQL = """e AS (SELECT event_id, event_type AS want, (props->>'k')::INT AS k FROM events),
cases AS (SELECT event_id, want, 'correct' AS "case", want AS name, k AS arg, true AS fits FROM e UNION ALL SELECT event_id, want, 'function_correct_arguments_wrong', want, k + 1, false FROM e
  UNION ALL SELECT event_id, want, 'function_wrong', want || '__wrong', k, true FROM e UNION ALL SELECT event_id, want, 'function_correct_arguments_partial', want, NULL, false FROM e)"""


@query(f"WITH {CASES_SQL} SELECT event_id, \"case\", name, arg FROM cases")
def prediction_cases(t):
    return _cases(t).select("event_id", "case", "name", "arg")


@query(f"""
WITH {CASES_SQL}, v AS (SELECT *, name = want AS router, name = want AND fits AS validator FROM cases)
SELECT "case", count(*) AS n, count(*) FILTER (router) AS router_true, count(*) FILTER (NOT router) AS router_false,
  count(*) FILTER (validator) AS validator_true, count(*) FILTER (NOT validator) AS validator_false, min(event_id) AS example FROM v GROUP BY "case" """)
def signal_matrix(t):
    router, validator = F.col("router"), F.col("validator")
    return _cases(t).groupBy("case").agg(
        F.count("*").alias("n"),
        F.count_if(router).alias("router_true"),
        F.count_if(~router).alias("router_false"),
        F.count_if(validator).alias("validator_true"),
        F.count_if(~validator).alias("validator_false"),
        F.min("event_id").alias("example"),
    )


@query("""
SELECT event_id, event_type IN ('click', 'view') AND (props->>'k')::INT % 10 IN (1, 2, 3) AS matches FROM events""")
def args_match(t):
    """Keys equal to the required ones and each value accepted (scalar arguments, all in Spark)."""
    arguments = F.create_map(F.lit("arm"), F.col("event_type"), F.lit("digit"), (arg_k() % 10).cast("string"))
    options = F.create_map(
        F.lit("arm"), F.array(F.lit("click"), F.lit("view")), F.lit("digit"), F.array(*map(F.lit, ("", "1", "2", "3"))), F.lit("note"), F.array(F.lit(""))
    )
    return t.events.select("event_id", c.flat_args_match(arguments, options).alias("matches"))


@query("""
WITH u AS (SELECT user_id, list_sort(list((props->>'k')::INT % 3) FILTER (event_type = 'click')) AS a, list_sort(list((props->>'k')::INT % 3) FILTER (event_type = 'view')) AS b FROM events GROUP BY user_id)
SELECT user_id, coalesce(a, []) = coalesce(b, []) AS equal FROM u""")
def multiset_equal(t):
    """Equal multisets: every value counted equally often on both sides (no lists are built)."""
    rows = t.events.filter("event_type in ('click', 'view')").select("user_id", (arg_k() % 3).alias("k"), F.when(F.col("event_type") == "click", 1).otherwise(-1).alias("side"))
    differs = rows.groupBy("user_id", "k").agg(F.sum("side").alias("net")).groupBy("user_id").agg(F.bool_or(F.col("net") != 0).alias("differs"))
    users = t.events.select("user_id").distinct()
    return users.join(differs, "user_id", "left").select("user_id", (~F.coalesce("differs", F.lit(False))).alias("equal"))


@query("""
SELECT vec_id, list_transform(list_zip(range(1, len(embedding) + 1), embedding), lambda p: CASE WHEN p[1] <= 4 THEN -100 ELSE round(p[2] * 1000)::INT END)::VARCHAR AS labels FROM embeddings""")
def mask_prefix(t):
    """Labels with a masked start; the product is taken in single precision, as a float times a whole number would be a double here."""
    thousand = F.lit(1000).cast("float")
    masked = F.transform("embedding", lambda v, i: F.when(i < 4, F.lit(-100)).otherwise(F.round(v * thousand).cast("int")))
    shown = F.array_join(F.coalesce(masked.cast("array<string>"), F.array().cast("array<string>")), ", ", "NULL")
    return t.embeddings.select("vec_id", F.concat(F.lit("["), shown, F.lit("]")).alias("labels"))


@query("""
WITH c AS (SELECT conv_id, list(length(text) ORDER BY turn) AS ids FROM conversations GROUP BY conv_id), g AS (SELECT conv_id, ids, max(len(ids)) OVER (PARTITION BY conv_id % 8) AS n FROM c)
SELECT conv_id, list_concat(ids, list_transform(range(0, n - len(ids)), lambda i: 0))::VARCHAR AS ids, len(ids) AS n_real FROM g""")
def pad_collate(t):
    """Arrays padded to the longest of their batch, whose length is a pre-aggregated maximum."""
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda s: s["n"])
    rows = t.conversations.groupBy("conv_id").agg(sizes.alias("ids")).withColumn("batch", F.col("conv_id") % 8)
    longest = rows.groupBy("batch").agg(F.max(F.size("ids")).alias("n"))
    padded = F.concat("ids", F.array_repeat(F.lit(0), F.col("n") - F.size("ids")))
    text = F.concat(F.lit("["), F.array_join(padded.cast("array<string>"), ", "), F.lit("]"))
    return rows.join(F.broadcast(longest), "batch").select("conv_id", text.alias("ids"), F.size("ids").cast("long").alias("n_real"))  # eight batches


@query("""
SELECT step, round(CASE WHEN step < 10 THEN step / 10 ELSE 0.5 * (1 + cos(pi() * (step - 10) / 90)) END, 6) AS rate FROM (SELECT unnest(range(0, 101)) AS step)""")
def cosine_schedule(t):
    """Learning-rate factor over 100 steps with 10 of warm-up."""
    return t.spark.range(101).select(F.col("id").alias("step")).select("step", r6(cosine_rate(F.col("step"), 10, 100)).alias("rate"))


@query("""
WITH n AS (SELECT vec_id, list_transform(embedding, lambda v: abs(v::DOUBLE) + 0.001) AS w FROM embeddings), p AS (SELECT vec_id, list_transform(w, lambda v: v / list_sum(w)) AS p FROM n)
SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.p, b.p), lambda z: z[1] * ln(z[1] / z[2]))), 6) AS kl FROM p a JOIN p b ON b.vec_id = a.vec_id + 1""")
def kl_divergence(t):
    weights = F.transform("embedding", lambda v: F.abs(v.cast("double")) + 0.001)
    rows = t.embeddings.select("vec_id", weights.alias("w")).withColumn("sum", F.aggregate("w", F.lit(0.0), lambda a, v: a + v))
    shares = rows.select("vec_id", F.transform("w", lambda v: v / F.col("sum")).alias("p"))
    after = shares.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"))
    return shares.join(after, "vec_id").select("vec_id", r6(divergence(F.col("p"), F.col("q"))).alias("kl"))


# ---- calls rendered from events -----------------------------------------

def source():
    return F.concat("event_type", F.lit("(k="), arg_k().cast("string"), F.lit(", tag='x')"))


def call_object():
    return F.concat(F.lit('{"name": "'), "event_type", F.lit('", "arguments": {"k": '), arg_k().cast("string"), F.lit("}}"))


CANON = "'{\"arguments\": {\"k\": ' || (props->>'k') || '}, \"name\": \"' || event_type || '\"}'"
CALL_TYPE = "name string, arguments string"


def _shown(call):
    return {"name": call.name, "arguments": json.dumps(call.arguments, sort_keys=True)}


@query("""SELECT event_id, event_type AS name, '{"k": ' || (props->>'k') || ', "tag": "x"}' AS arguments FROM events""")
def parse_call(t):
    parse = c.text_udf(lambda s: json.dumps(_shown(c.call_from(s))), "string", None)
    rows = t.events.select("event_id", F.from_json(parse(source()), CALL_TYPE).alias("call"))
    return rows.select("event_id", "call.name", "call.arguments")


@query("""
SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_type END AS name, CASE WHEN event_id % 5 > 0 THEN '{"k": ' || (props->>'k') || '}' END AS arguments, event_id % 5 = 0 AS parse_error FROM events""")
def parse_model_output(t):
    """Calls inside chatter, after braces that do not decode; every fifth output has none."""
    parse = c.text_udf(lambda s: json.dumps(_shown(c.call_in_output(s))), "string", None)
    output = F.concat(F.lit("Sure {not json} -> "), F.when(F.col("event_id") % 5 > 0, call_object()).otherwise("no call"), F.lit(" done {"))
    rows = t.events.select("event_id", F.from_json(parse(output), CALL_TYPE).alias("call"))
    return rows.select("event_id", "call.name", "call.arguments", F.col("call").isNull().alias("parse_error"))


def _two_calls():
    return F.concat(F.lit("Calls: ["), call_object(), F.lit(', {"other": {"a": 1}}] end'))


@query("""SELECT event_id, 2::BIGINT AS n_calls, event_type AS first_name, 'other' AS second_name FROM events""")
def parse_multi(t):
    found = tables.output_calls(t.events.select("event_id", _two_calls().alias("output")), "output")
    name = lambda place: F.max(F.when(F.col("place") == place, F.col("name")))
    return found.groupBy("event_id").agg(F.count("*").alias("n_calls"), name(1).alias("first_name"), name(2).alias("second_name"))


@query("""
WITH e AS (SELECT event_id, event_type, props->>'k' AS k FROM events)
SELECT event_id, 1 AS place, event_type AS name, '{"k": ' || k || '}' AS arguments, NULL AS error FROM e WHERE event_id % 4 <> 3
UNION ALL SELECT event_id, 2, 'other', '{"a": 1}', NULL FROM e WHERE event_id % 4 IN (0, 1)
UNION ALL SELECT event_id, 0, NULL, NULL, 'no calls' FROM e WHERE event_id % 4 = 3""")
def call_rows(t):
    """A row for each call of an output, with its place; outputs of two calls, of one, of none."""
    form = F.col("event_id") % 4
    output = F.when(form < 2, _two_calls()).when(form == 2, F.concat(F.lit("so: "), call_object())).otherwise(F.concat(F.lit("no idea of "), "event_type"))
    found = tables.output_calls(t.events.select("event_id", output.alias("output")), "output")
    return found.select("event_id", "place", "name", "arguments", "error")


@query("""SELECT doc_id, length(text) - length(replace(text, 'e', '')) AS n_e, ceil(length(text) / 4.0)::BIGINT AS n_quarters FROM documents""")
def injected_tokens(t):
    """Token counts by two injected tokenizers."""
    letters, quarters = tables.token_count(lambda: lambda s: re.findall("e", s)), tables.token_count(lambda: lambda s: range(0, len(s), 4))
    return t.documents.select("doc_id", letters(F.col("text")).alias("n_e"), quarters(F.col("text")).alias("n_quarters"))


@query("""SELECT event_id, event_type AS name, '{"k": [' || (props->>'k') || ', ""]}' AS accepted FROM events""")
def canonical_gt(t):
    canon = c.text_udf(lambda s: json.dumps({"name": (x := c.accepted_call(json.loads(s))).name, "accepted": json.dumps(x.arguments, sort_keys=True)}), "string", None)
    truth = F.concat(F.lit('[{"'), "event_type", F.lit('": {"k": ['), arg_k().cast("string"), F.lit(', ""]}}]'))
    rows = t.events.select("event_id", F.from_json(canon(truth), "name string, accepted string").alias("x"))
    return rows.select("event_id", "x.name", "x.accepted")


@query(f"SELECT event_id, {CANON} AS call FROM events")
def canonical_call(t):
    canon = c.text_udf(lambda s: c.call_from(json.loads(s)).canonical(), "string", None)
    return t.events.select("event_id", canon(call_object()).alias("call"))


@query("""
SELECT event_id, event_type = 'click' AS router, event_type = 'click' AND (props->>'k')::INT < 50 AS validator, event_type = 'click' AND (props->>'k')::INT < 50 AS call FROM events""")
def verify_call(t):
    truth = json.dumps([{"click": {"k": [*range(50), ""], "note": [""]}}])
    judge = c.text_udf(lambda s: json.dumps(dict(zip(("router", "validator", "call"), c.verdict(json.loads(s), json.loads(truth))))), "string", None)
    rows = t.events.select("event_id", F.from_json(judge(call_object()), "router boolean, validator boolean, call boolean").alias("v"))
    return rows.select("event_id", "v.router", "v.validator", "v.call")


@query("SELECT event_id, event_type IN ('click', 'view') AS matched FROM events")
def parallel_match(t):
    """Two calls in the other order than the truths; right if the arm is accepted."""

    def run(text):
        calls = json.loads(text)
        truths = [{"fixed": {"a": [1]}}, {"click": {"k": list(range(100))}}] if calls[0]["name"] != "view" else [{"fixed": {"a": [1]}}, {"view": {"k": list(range(100))}}]
        return c.parallel_match(calls, truths)

    matched = c.text_udf(run, "boolean", False)
    return t.events.select("event_id", matched(F.concat(F.lit("["), call_object(), F.lit(', {"name": "fixed", "arguments": {"a": 1}}]'))).alias("matched"))


@query("SELECT event_id, event_id % 3 = 0 AS parseable FROM events")
def parseable_gt(t):
    test = c.text_udf(lambda s: c.parseable(json.loads(s)), "boolean", False)
    one = F.concat(F.lit('{"'), "event_type", F.lit('": {"k": ['), arg_k().cast("string"), F.lit("]}}"))
    shape = F.col("event_id") % 3
    truth = F.when(shape == 0, F.concat(F.lit("["), one, F.lit("]"))).when(shape == 1, F.concat(F.lit("["), one, F.lit(","), one, F.lit("]"))).otherwise(F.lit('["35"]'))
    return t.events.select("event_id", test(truth).alias("parseable"))


@query("""
WITH RECURSIVE d AS (SELECT event_type, day(ts)::BIGINT AS step, row_number() OVER (PARTITION BY event_type ORDER BY day(ts)) AS i FROM events GROUP BY event_type, day(ts)),
f AS (
  SELECT event_type, 0::BIGINT AS i, 0::BIGINT AS step, 0::BIGINT AS mask, 0::BIGINT AS kept, false AS accepted FROM d WHERE i = 1
  UNION ALL
  SELECT event_type, i, step, CASE WHEN good THEN mask | bits ELSE mask END, kept + good::BIGINT, good FROM (
    SELECT *, len(list_filter(oks, lambda e: (mask >> e) & 1 = 0)) > 0 AND len(list_filter(bad, lambda e: (mask >> e) & 1 = 1)) = 0 AS good,
           coalesce(list_sum(list_transform(oks, lambda e: 1::BIGINT << e)), 0)::BIGINT AS bits FROM (
      SELECT f.event_type, d.i, d.step, f.mask, f.kept,
             list_filter(range(d.step % 3, 12, 3), lambda e: (e * 7 + d.step * 13 + f.kept) % 5 > 1 OR (e + d.step) % 4 = 0) AS oks,
             list_filter(range(d.step % 3, 12, 3), lambda e: NOT ((e * 7 + d.step * 13 + f.kept) % 5 > 1 OR (e + d.step) % 4 = 0)) AS bad
      FROM f JOIN d ON d.event_type = f.event_type AND d.i = f.i + 1)))
SELECT event_type, step, accepted, bit_count(mask)::BIGINT AS n_solved FROM f WHERE i > 0""")
def greedy_fold(t):
    """Candidates (days) folded in order per arm with a deterministic stub model."""

    def runner(kept, row):
        return {e: (e * 7 + row["step"] * 13 + len(kept)) % 5 > 1 or (e + row["step"]) % 4 == 0 for e in range(row["step"] % 3, 12, 3)}

    days = t.events.groupBy("event_type", F.dayofmonth("ts").alias("step")).agg(F.count("*").alias("n"))
    return loop.greedy_fold(days.withColumn("step", F.col("step").cast("long")), "event_type", "step", runner, "event_type string, step long, accepted boolean, n_solved long")


@query("""
WITH e AS (SELECT event_id, event_type, (props->>'k')::INT AS k FROM events), r AS (SELECT *, k % 4 <> 0 AS router, k % 4 <> 0 AND k % 3 <> 0 AS validator FROM e)
SELECT event_id, router, validator, router AND validator AS call_success, CASE WHEN NOT router THEN 'router_fail' WHEN NOT validator THEN 'validator_fail' ELSE 'none' END AS failure_class FROM r""")
def collect_failures(t):
    """Generate (stub), judge and classify every record that is not recorded yet."""
    k = arg_k()
    name = F.when(k % 4 == 0, F.lit("other")).otherwise(F.col("event_type"))
    value = F.when(k % 3 == 0, k + 1).otherwise(k).cast("string")
    output = F.concat(F.lit('{"name": "'), name, F.lit('", "arguments": {"k": '), value, F.lit("}}"))
    truth = F.concat(F.lit('[{"'), F.col("event_type"), F.lit('": {"k": ['), k.cast("string"), F.lit("]}}]"))

    def run(text, want):
        got = c.call_in_output(text)
        return json.dumps(dict(zip(("router", "validator", "call"), c.verdict({"name": got.name, "arguments": got.arguments}, json.loads(want)))))

    judged = F.from_json(c.text_udf(run, "string", None)(output, truth), "router boolean, validator boolean, call boolean")
    rows = t.events.select("event_id", judged.alias("v")).select("event_id", "v.router", "v.validator", F.col("v.call").alias("call_success"))
    return rows.withColumn("failure_class", failure_class(F.col("router"), F.col("validator")))


@query("""
WITH h AS (SELECT user_id, props, min(event_id) AS event_id FROM events WHERE value > 100 GROUP BY user_id, props), m AS (SELECT count(*) AS n FROM h),
r AS (SELECT event_id, row_number() OVER (ORDER BY sha256('20260702:replay:' || event_id), event_id) AS i FROM events WHERE value <= 100)
SELECT event_id, 'main' AS kind FROM h UNION ALL SELECT event_id, 'replay' FROM r WHERE i <= (SELECT n // 2 FROM m)""")
def build_dataset(t):
    """Verified rows without repeats, and half as many replay rows by hash."""
    rows = t.events.select("event_id", "user_id", "props", "value")
    main = o.keep_first(rows.filter("value > 100"), ["user_id", "props"], "event_id").select("event_id", F.lit("main").alias("kind"))
    replay = o.sample_by_hash(rows.filter("value <= 100"), main.count() // 2, [o.DATASET_SEED, "replay", F.col("event_id")], "event_id")
    return main.unionByName(replay.select("event_id", F.lit("replay").alias("kind")))


@query(f"""
WITH {SPLIT}, k AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('20260704:arena:' || doc_id), doc_id) AS i FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM split WHERE part = 'train' OR quality = 0))
SELECT doc_id FROM k WHERE i <= 400""")
def build_arena(t):
    """Up to 400 documents (the arena's own size) that nothing trained on and no failure touched."""
    return _arena(t, F.lit(True)).rows.select("doc_id")


def _arena(t, success):
    split = o.split_by_hash(t.labels, "doc_id")
    touched = {"training": split.filter("part = 'train'").select("doc_id"), "failures": split.filter("quality = 0").select("doc_id")}
    return arena.build(t.documents.select("doc_id", "lang"), "doc_id", success, touched, 400, 250, o.ARENA_SEED)


@query(f"""
WITH {SPLIT}, k AS (SELECT doc_id, lang, row_number() OVER (ORDER BY sha256('20260704:arena:' || doc_id), doc_id) AS i FROM documents
  WHERE doc_id % 3 > 0 AND doc_id NOT IN (SELECT doc_id FROM split WHERE part = 'train' OR quality = 0)),
c AS (SELECT lang, count(*) AS n FROM k WHERE i <= 400 GROUP BY lang)
SELECT lang AS category, n, (SELECT count(*) FROM k) AS available, (SELECT count(*) FROM k WHERE i <= 400) AS selected,
  CASE WHEN (SELECT count(*) FROM k) >= 250 THEN 'ready' ELSE 'insufficient' END AS status FROM c""")
def arena_report(t):
    """Categories of an arena of successes, beside what was free and the arena's state."""
    made = _arena(t, F.col("doc_id") % 3 > 0)
    report = made.report(400).drop("requested")
    return made.distribution("lang").withColumnRenamed("lang", "category").join(report, F.lit(True))  # one row on the right
