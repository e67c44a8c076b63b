"""Preference formatting of chosen and rejected conversations.

The longest common turn prefix is found in the row, rendered once as the
prompt, and the rest of either side becomes a completion with a mask: the
spans (code points, end exclusive) of the completion that carry loss, which
are the assistant's texts and their end markers.

Defined results: null sides count as no turns; null roles and texts render as
empty; equal sides give two empty completions; a marker that stands inside a
text is broken up, so a text can't open or close a turn. Extra columns stay.
An empty table gives no rows; repeated rows are each formatted; turns that tie
in their number are ordered by role and text; texts of any length and any
number of turns take time in proportion, up to a logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomspan.llm.common import running_sums

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit(OPEN), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(turn["role"]), F.lit(MIDDLE))


def _body(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def loss_spans(turns: Column, trained: str = "assistant") -> Column:
    """``start:end`` of the trained turns' bodies in the rendered turns."""
    body = F.transform(turns, lambda t: F.length(_body(t)).cast("long"))
    ends = running_sums(F.transform(turns, lambda t: (F.length(_head(t)) + F.length(_body(t))).cast("long")))
    trains = F.transform(turns, lambda t: F.coalesce(t["role"] == trained, F.lit(False)))
    rows = F.filter(F.arrays_zip(body.alias("size"), ends.alias("end"), trains.alias("trains")), lambda r: r["trains"])
    return F.transform(rows, lambda r: F.concat_ws(":", (r["end"] - r["size"]).cast("string"), r["end"].cast("string")))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", trained: str = "assistant") -> DataFrame:
    """Add n_prefix_turns, prompt, and text and loss spans of both completions."""
    sides = {"_a": F.coalesce(F.col(chosen).cast(TURNS), F.array().cast(TURNS)), "_b": F.coalesce(F.col(rejected).cast(TURNS), F.array().cast(TURNS))}
    out = pairs.withColumns(sides)
    both = F.least(F.size("_a"), F.size("_b"))
    same = F.zip_with(F.slice("_a", 1, F.greatest(both, F.lit(0))), F.slice("_b", 1, F.greatest(both, F.lit(0))), lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(same, False)
    out = out.withColumn("n_prefix_turns", F.when(differs > 0, differs - 1).otherwise(both).cast("long"))
    n = F.col("n_prefix_turns").cast("int")
    rest = lambda side: F.slice(side, n + 1, F.greatest(F.size(side) - n, F.lit(0)))
    out = out.withColumns({"_p": F.slice("_a", F.lit(1), n), "_a": rest("_a"), "_b": rest("_b")})
    return out.withColumns(
        {
            "prompt": render(F.col("_p")),
            "chosen_completion": render(F.col("_a")),
            "chosen_spans": loss_spans(F.col("_a"), trained),
            "rejected_completion": render(F.col("_b")),
            "rejected_spans": loss_spans(F.col("_b"), trained),
        }
    ).drop("_p", "_a", "_b")


def stale_reply_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from single conversations: the chosen side is the whole conversation.

    On the rejected side every reply (assistant turn) after the first repeats
    the first one; an only reply is empty there. Turns are ordered by turn,
    role and text. Without a reply both sides are equal.
    """
    row = F.struct("turn", "role", "text")
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    is_reply = lambda t: F.coalesce(t["role"] == "assistant", F.lit(False))
    place = F.transform("all", lambda t, i: F.when(is_reply(t), i))
    whole = whole.withColumn("_at", F.filter(place, lambda i: i.isNotNull()))
    whole = whole.withColumn("_first", F.get("all", F.get("_at", F.lit(0)))["text"])
    stale = F.when(F.size("_at") > 1, F.col("_first")).otherwise(F.lit(""))
    shown = lambda t, text: F.struct(t["role"].alias("role"), text.alias("text"))
    return whole.select(
        "conv_id",
        F.transform("all", lambda t: shown(t, t["text"])).alias("chosen"),
        F.transform("all", lambda t: shown(t, F.when(is_reply(t), stale).otherwise(t["text"]))).alias("rejected"),
    )


def op8_preference_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = format_preferences(stale_reply_pairs(turns))
    return out.select(
        "conv_id",
        "n_prefix_turns",
        "prompt",
        "chosen_completion",
        F.array_join("chosen_spans", ",").alias("chosen_spans"),
        "rejected_completion",
        F.array_join("rejected_spans", ",").alias("rejected_spans"),
    )


OP8_SQL = """
WITH o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
         coalesce(role = 'assistant', false) AS reply
  FROM conversations),
f AS (SELECT conv_id, count(*) FILTER (reply) AS replies, arg_min_null(text, n) FILTER (reply) AS first_text FROM o GROUP BY conv_id),
u AS (
  SELECT o.conv_id, n, reply, role, text, CASE WHEN NOT reply THEN text WHEN replies > 1 THEN first_text ELSE '' END AS other
  FROM o JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id),
d AS (SELECT conv_id, min(n) FILTER (other IS DISTINCT FROM text) AS cut FROM u GROUP BY conv_id),
s AS (
  SELECT u.conv_id, n, reply, coalesce(n >= cut, false) AS rest,
         '<|' || replace(coalesce(role, ''), '<|', '< |') || '|>' || chr(10) AS head,
         replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS x,
         replace(coalesce(other, ''), '<|', '< |') || '<|end|>' || chr(10) AS y
  FROM u JOIN d ON d.conv_id IS NOT DISTINCT FROM u.conv_id),
e AS (
  SELECT *, sum(length(head) + length(x)) OVER w AS x_end, sum(length(head) + length(y)) OVER w AS y_end
  FROM s WINDOW w AS (PARTITION BY conv_id, rest ORDER BY n))
SELECT conv_id, count(*) FILTER (NOT rest)::BIGINT AS n_prefix_turns,
       coalesce(string_agg(head || x, '' ORDER BY n) FILTER (NOT rest), '') AS prompt,
       coalesce(string_agg(head || x, '' ORDER BY n) FILTER (rest), '') AS chosen_completion,
       coalesce(string_agg((x_end - length(x)) || ':' || x_end, ',' ORDER BY n) FILTER (rest AND reply), '') AS chosen_spans,
       coalesce(string_agg(head || y, '' ORDER BY n) FILTER (rest), '') AS rejected_completion,
       coalesce(string_agg((y_end - length(y)) || ':' || y_end, ',' ORDER BY n) FILTER (rest AND reply), '') AS rejected_spans
FROM e GROUP BY conv_id
"""
