"""Round trips through the sources and sinks: the tables written, and read again by the library's readers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomspan.operators import collection
from loomspan.operators.probe import merge_shards
from loomspan.operators.summaries import r6
from loomspan.plans.registry import query
from loomspan.sources import records, sinks
from loomspan.sources.commits import Saves
from loomspan.sources.shards import ShardRun
from loomspan.shared import fresh_folder
from loomspan.streaming import resume

LABELS = "doc_id long, quality int, toxic int"


@query("SELECT doc_id, lang, source FROM documents")
def source_jsonl(t):
    """Rows as JSON lines and back by a schema."""
    folder = fresh_folder(t.spark, "jsonl")
    sinks.write_jsonl(t.documents.select("doc_id", "lang", "source"), folder)
    return records.jsonl(t.spark, folder, "doc_id long, lang string, source string").drop("file_name")


@query("SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS query FROM conversations GROUP BY conv_id")
def query_text(t):
    """Questions of nested turns, read as VARIANT; the first list of messages is the query."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    messages = F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    rows = t.conversations.groupBy("conv_id").agg(F.array(messages).alias("question"))
    folder = fresh_folder(t.spark, "questions")
    sinks.write_jsonl(rows, folder)
    read = records.jsonl(t.spark, folder)
    question = F.try_variant_get("record", "$.question", "variant")
    return read.select(F.variant_get("record", "$.conv_id", "long").alias("conv_id"), records.query_text(question).alias("query"))


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality = 1")
def source_optional(t):
    """A source that is there and one that is not."""
    folder = fresh_folder(t.spark, "optional")
    sinks.write_jsonl(t.labels.filter("quality = 1"), folder)
    there, missing = (records.jsonl_or_empty(t.spark, path, LABELS) for path in (folder, f"{folder}-none"))
    return there.unionByName(missing).drop("file_name")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def source_document(t):
    """A report as one JSON document, read again whole."""
    folder = fresh_folder(t.spark, "document")
    sinks.write_document(t.labels.groupBy("quality", "toxic").agg(F.count("*").alias("n")), folder)
    return records.json_document(t.spark, folder, "quality int, toxic int, n long")


@query("""
WITH l AS (SELECT lang, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY lang)
SELECT lang AS category, n, first_id FROM l WHERE lang <> 'en'""")
def source_categories(t):
    """Records of several categories, chosen by a name pattern, the category taken from the name."""
    folder = fresh_folder(t.spark, "categories")
    prefix = F.when(F.col("lang") == "en", "other").otherwise("Data")
    sinks.write_named(t.documents.select("doc_id", F.concat(prefix, F.lit("_v1_"), "lang", F.lit(".json")).alias("file")), folder, "file")
    rows = records.named_jsonl(t.spark, folder, "doc_id long", "Data_v1_*.json")
    return rows.groupBy(records.category().alias("category")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""SELECT doc_id, lang, 'part-' || (doc_id % 3) AS shard FROM documents WHERE doc_id % 3 < 2""")
def source_shards(t):
    """Exploded records of shard documents named in a list of paths."""
    folder = fresh_folder(t.spark, "shards")
    chunks = 1 + t.documents.count() // 3_000  # a document holds some thousand records, whatever the table's size
    spread = t.documents.select("doc_id", "lang", F.concat(F.lit("part-"), (F.col("doc_id") % 3).cast("string")).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk"))
    docs = spread.groupBy("shard", "chunk").agg(F.collect_list(F.struct("doc_id", "lang")).alias("records"))
    docs.repartition("shard", "chunk").write.partitionBy("shard", "chunk").json(folder)  # one document a file
    schema = "records array<struct<doc_id:long,lang:string>>"
    read = [records.records_of(t.spark, f"{folder}/shard=part-{i}", schema).withColumn("shard", F.lit(f"part-{i}")) for i in range(2)]
    return read[0].unionByName(read[1]).drop("file_name")


def _files(t):
    """Questions and answers of the labelled documents as JSON lines, a file per quality."""
    folder = fresh_folder(t.spark, "episodes")
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    name = F.concat(F.lit("q"), F.col("doc_id").cast("string"))
    fn = F.struct(F.concat(F.lit("read_"), "lang").alias("name"), F.lit("reads").alias("description"))
    question = F.concat(F.lit("text "), F.col("doc_id").cast("string"))
    file = F.concat(F.lit("Data_v1_quality"), F.col("quality").cast("string"), F.lit(".json")).alias("file")
    truth = F.array(F.create_map(F.concat(F.lit("read_"), "lang"), F.create_map(F.lit("k"), F.array("toxic"))))
    sinks.write_named(rows.select(name.alias("id"), question.alias("question"), F.array(fn).alias("function"), file), f"{folder}/questions", "file")
    sinks.write_named(rows.select(name.alias("id"), truth.alias("ground_truth"), file), f"{folder}/answers", "file")
    read = lambda side: records.named_jsonl(t.spark, f"{folder}/{side}")
    return records.episodes(read("questions"), read("answers"))


_EPISODES = "SELECT 'q' || doc_id AS episode_id, 'text ' || doc_id AS query, 'quality' || quality AS category, 'read_' || lang AS function_name, toxic AS accepted FROM labels JOIN documents USING (doc_id)"


def _shown(rows):
    name = F.variant_get("function_pool", "$[0].name", "string")
    accepted = F.element_at(F.map_values(F.map_values(F.variant_get("ground_truth", "$[0]", "map<string,map<string,array<int>>>"))[0])[0], 1)
    return rows.select("episode_id", "query", "category", name.alias("function_name"), accepted.alias("accepted"))


@query(_EPISODES)
def load_categories(t):
    """Questions with their answers, over the files of all categories."""
    return _shown(_files(t))


@query(f"SELECT * FROM ({_EPISODES}) WHERE NOT (category = 'quality1' AND accepted = 1)")
def load_unrecorded(t):
    """The same without the episodes of one category that an earlier output records."""
    rows = _shown(_files(t))
    recorded = rows.filter("category = 'quality1' and accepted = 1")
    return records.in_order(records.without_recorded(rows, recorded))


@query("""
WITH f AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('20260630:q' || doc_id), 'q' || doc_id) AS r, count(*) OVER () AS n FROM labels WHERE quality = 0)
SELECT 'q' || doc_id AS episode_id, CASE WHEN r <= floor(n * 0.5) THEN 'train' WHEN r <= floor(n * 0.5) + floor(n * 0.25) THEN 'validation' ELSE 'held_out' END AS part, 3 AS budget FROM f""")
def load_inputs(t):
    """The failures of a split with their parts, beside the row of a seed (an error without one)."""
    rows = t.labels.select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("episode_id"), F.lit("multiple").alias("split"), (F.col("quality") == 1).alias("call_success"))
    failures = records.failures_of(rows, "multiple", 20260630)
    seeds = t.spark.createDataFrame([(20260629, 2), (20260630, 3)], "seed long, budget int")
    budget = records.seed_row(seeds, 20260630).first()["budget"]
    return failures.select("episode_id", "part", F.lit(budget).alias("budget"))


@query("SELECT doc_id, quality, toxic FROM labels")
def resume_sink(t):
    """Half of the rows, then all of them, into a sink that keeps each id once."""
    folder = fresh_folder(t.spark, "resume")
    sinks.append_unseen(t.labels.filter("quality = 1"), folder, "doc_id", None)
    sinks.append_unseen(t.labels, folder, "doc_id", t.spark.read.parquet(folder))
    return t.spark.read.parquet(folder)


@query("SELECT doc_id, toxic AS seed, CASE WHEN toxic = 1 THEN 2 ELSE 1 END AS pass FROM labels")
def sink_by_seed(t):
    """A second pass over one seed replaces that seed alone."""
    folder = fresh_folder(t.spark, "seeds")
    rows = t.labels.select("doc_id", F.col("toxic").alias("seed"), F.lit(1).alias("pass"))
    sinks.write_by_seed(rows, folder)
    sinks.write_by_seed(rows.filter("seed = 1").withColumn("pass", F.lit(2)), folder)
    return t.spark.read.parquet(folder).select("doc_id", "seed", "pass")


@query("SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_unique FROM events")
def sink_counts(t):
    """What a sink wrote, counted on the way and read back."""
    found = sinks.write_with_counts(t.events.select("event_id", "user_id"), fresh_folder(t.spark, "counts"), "user_id")
    return t.spark.createDataFrame([(found["rows"], found["unique"])], "n_rows long, n_unique long")


@query("""
WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY event_type),
lines AS (SELECT 4 + row_number() OVER (ORDER BY event_type) AS line_no, '| ' || event_type || ' | ' || n || ' | ' || printf('%.4f', mean) || ' | NA |' AS line FROM s)
SELECT * FROM lines UNION ALL SELECT 1, '# Events' UNION ALL SELECT 2, '' UNION ALL SELECT 3, '| event_type | n | mean | missing |' UNION ALL SELECT 4, '|---|---|---|---|'""")
def report_markdown(t):
    """The lines of a report's table."""
    made = t.events.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), F.lit(None).cast("double").alias("missing")).orderBy("event_type")
    text = sinks.markdown(made, "Events").rstrip("\n").split("\n")
    return t.spark.createDataFrame(list(enumerate(text, 1)), "line_no long, line string")


@query("SELECT doc_id, quality, quality = 1 AS success FROM labels")
def stream_collect(t):
    """A file stream judged once per id, though every row arrives twice and the query starts again."""
    folder = fresh_folder(t.spark, "stream")
    judge = lambda rows: rows.select("doc_id", "quality", (F.col("quality") == 1).alias("success"))
    for _ in range(2):
        t.labels.write.mode("append").json(f"{folder}/in")
        resume.collect_stream(t.spark, f"{folder}/in", LABELS, "doc_id", judge, f"{folder}/out", f"{folder}/state").awaitTermination()
    return Saves(t.spark, f"{folder}/out").read().select("doc_id", "quality", "success")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg((value > 8)::INT), 6) AS rate FROM events GROUP BY 1, 2")
def windowed_rates(t):
    """Success rates per hour and arm."""
    return resume.windowed_rates(t.events.withColumn("success", F.col("value") > 8)).withColumn("rate", r6(F.col("rate")))


LABELLED = """e AS (SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY doc_id) AS ord FROM labels),
r AS (SELECT *, ((ord - 1) % 5)::INT AS shard, doc_id % 3 = 0 AS teacher_success, (quality * (doc_id % 4))::INT AS hits,
  'fn_' || doc_id % 7 AS function_name, CASE WHEN toxic = 1 THEN 'router_fail' ELSE 'validator_fail' END AS failure_class FROM e),
p AS (SELECT *, CASE WHEN hits > 0 THEN 'sampling_rescuable' WHEN teacher_success THEN 'scaffold_only' ELSE 'neither' END AS partition FROM r)"""


def _shard_run(t):
    """Five shards of the labelled documents: two are run, an attempt at the others loses rows of one, a last run takes up what is missing."""

    def work(items):
        kind = F.when(F.col("toxic") == 1, "router_fail").otherwise("validator_fail")
        hits = (F.col("quality") * (F.col("doc_id") % 4)).cast("int")
        return items.select(
            "doc_id", "shard", (F.col("doc_id") % 3 == 0).alias("teacher_success"), hits.alias("hits"), F.concat(F.lit("fn_"), F.col("doc_id") % 7).alias("function_name"), kind.alias("failure_class"),
            F.slice(F.sequence(F.lit(0), F.lit(3)), F.lit(1), hits).alias("successful"),
        )

    run = ShardRun(t.spark, fresh_folder(t.spark, "shards"), "doc_id")
    run.prepare(t.labels, ["doc_id"], 5)
    run.run(work, [0, 1])
    try:
        run.run(lambda items: work(items).filter("shard <> 3 OR doc_id % 2 = 0"), [2, 3, 4])
    except ValueError:  # the lost shard has no commit
        run.run(work)
    return run


@query(f"WITH {LABELLED} SELECT doc_id, ord, shard, function_name, partition FROM p")
def shard_runs(t):
    """Rows of the merged shards in order, though one was lost on the way."""
    merged = merge_shards(_shard_run(t).merge(), "doc_id", {})
    return merged.records.select("doc_id", "ord", "shard", "function_name", "partition")


@query(f"""
WITH {LABELLED} SELECT count(*) AS total_failures, count(*) FILTER (teacher_success) AS repaired_count, CASE WHEN count(*) FILTER (teacher_success) >= 50 THEN 'GO' ELSE 'STOP_LT_50' END AS gate,
  count(*) FILTER (partition = 'scaffold_only') AS scaffold_only, round(count(*) FILTER (partition = 'scaffold_only') / count(*), 6) AS scaffold_only_rate,
  round(count(*) FILTER (partition = 'sampling_rescuable' AND teacher_success) / count(*) FILTER (teacher_success), 6) AS rescued_repaired_rate,
  (SELECT count(*) FROM p WHERE teacher_success) AS repaired_rows, (SELECT sum(hits) FROM p)::BIGINT AS sample_rows FROM p""")
def shard_inventory(t):
    """The four outputs of the merge, read back."""
    folder = fresh_folder(t.spark, "merged")
    held_out = t.documents.select(-F.col("doc_id") - 1).toDF("doc_id")  # no repaired record is in it
    merge_shards(_shard_run(t).merge(), "doc_id", {"held-out": held_out}, folder)
    n = lambda name: records.jsonl(t.spark, f"{folder}/{name}", "doc_id long").agg(F.count("*").alias(f"{name}_rows"))
    shown = records.json_document(t.spark, f"{folder}/partition").select(
        "total_failures", "repaired_count", "scaffold_only", r6(F.col("scaffold_only_rate")).alias("scaffold_only_rate"), r6(F.col("sampling_rescuable_repaired_rate")).alias("rescued_repaired_rate")
    )
    gate = records.json_document(t.spark, f"{folder}/inventory").select("gate")
    counts = n("repaired").join(n("samples").withColumnRenamed("samples_rows", "sample_rows"), F.lit(True))
    return shown.join(gate, F.lit(True)).join(counts, F.lit(True))  # one row each


EPISODES = """e AS (SELECT doc_id, quality, toxic, 'q' || doc_id AS episode_id, CASE WHEN quality = 1 THEN 'multiple' ELSE 'simple' END AS split, lang AS category,
  lang || '/' || toxic || '/' || doc_id % 5 AS query FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, doc_id % 5 <> 4 AS parsed, doc_id % 5 NOT IN (3, 4) AS router_success, doc_id % 5 NOT IN (2, 3, 4) AS call_success FROM e)"""


def _collected(t):
    """Records of the labelled documents' episodes; the first run ends after one save, the second takes up the rest."""
    lang, rest = F.col("lang"), (F.col("doc_id") % 5).cast("string")
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select(
        F.concat(F.lit("q"), F.col("doc_id")).alias("episode_id"),
        F.when(F.col("quality") == 1, "multiple").otherwise("simple").alias("split"),
        lang.alias("category"),
        F.concat_ws("/", lang, F.col("toxic"), rest).alias("query"),
        F.to_json(F.array(F.struct(F.concat(F.lit("read_"), lang).alias("name")))).alias("function_pool"),
        F.to_json(F.struct(F.concat(F.lit("read_"), lang).alias("name"), F.create_map(F.lit("toxic"), F.array("toxic")).alias("accepted_arguments"))).alias("ground_truth"),
    )

    def make_runner():
        def answer(query):
            """A right call, or one of four kinds of wrong ones, by the question."""
            lang, toxic, form = query.split("/")
            if form == "4":
                return f"I cannot read {lang}"
            name = f"write_{lang}" if form == "3" else f"read_{lang}"
            return json.dumps({"name": name, "arguments": {"toxic": int(toxic) + (form == "2")}})

        return answer

    folder = fresh_folder(t.spark, "collection")
    order, half = ["split", "category", "episode_id"], max(1, rows.count() // 2)
    collection.collect(rows, order, make_runner, folder, half, most_saves=1)
    return collection.collect(rows, order, make_runner, folder, half)


@query(f"""
WITH {EPISODES} SELECT episode_id, split, category, query, parsed, router_success, call_success, CASE WHEN NOT router_success THEN 'router_fail' WHEN NOT call_success THEN 'validator_fail' ELSE 'none' END AS failure_class,
  CASE WHEN parsed THEN CASE WHEN doc_id % 5 = 3 THEN 'write_' ELSE 'read_' END || category END AS predicted_name FROM r""")
def collect_run(t):
    """Scan, sort, resume, generate, judge and save: every episode asked once over two runs."""
    name = F.get_json_object("predicted_call", "$.name").alias("predicted_name")
    return _collected(t).select("episode_id", "split", "category", "query", F.col("parse_error").isNull().alias("parsed"), "router_success", "call_success", "failure_class", name)


@query(f"""
WITH {EPISODES} SELECT split, count(*) AS n_total, count(*) FILTER (NOT call_success) AS n_failures, count(*) FILTER (NOT router_success) AS n_router_fail,
  count(*) FILTER (router_success AND NOT call_success) AS n_validator_fail, count(*) FILTER (NOT call_success) > 0 AS some_fail, count(*) FILTER (call_success) > 0 AS some_pass FROM r GROUP BY split""")
def collect_summary(t):
    """The report of a collection, with its two checks per split."""
    return collection.summary(_collected(t))
