"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed (SHA-256). The ledger holds one
row per scanned (blob, rule version) pair; a run scans only the pairs it does
not hold yet and joins the findings back to every path with that blob.

Only hashes are grouped: one representative path per unseen blob is chosen
from (blob, path) rows, and its text travels once, dealt by the unique
(blob, path) key, so a blob with a third of all paths makes no hot task.

Defined results: null texts count as empty; paths may repeat or be null; an
empty table or an empty ledger gives empty findings; columns other than the
path and the text do not matter.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomspan.llm.common import documents, fresh_folder, running_sums


@dataclass(frozen=True)
class SecretRule:
    """A match of ``pattern`` counts if group ``group`` has ``least`` characters.

    ``hint`` is a cheaper pattern found in every text with a match.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hint: str


RULES = (
    SecretRule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        r"""(?i:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]""",
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    # a run of the class is one match, so asking for its least length at once is the same
    SecretRule("hex", r"[0-9a-f]{24,}+", 0, 24, r"[0-9a-f]{24}"),
)


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


SPAN = "array<struct<start:long,kind_no:int,end:long>>"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, rule: SecretRule, number: int) -> Column:
    """Spans of a rule: the gaps before the matches and the matches add up to their ends."""
    lengths = lambda parts: F.transform(parts, lambda x: F.length(x).cast("long"))
    sizes = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    tests = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)))
    parts = F.struct(lengths(F.split(text, rule.pattern, -1)).alias("gaps"), sizes.alias("sizes"), tests.alias("tests"))
    ends = lambda p: running_sums(F.transform(p["sizes"], lambda size, i: F.get(p["gaps"], i) + size))
    rows = _once(parts, lambda p: F.arrays_zip(ends(p).alias("end"), p["sizes"].alias("size"), p["tests"].alias("test")))
    span = lambda r: F.struct((r["end"] - r["size"]).alias("start"), F.lit(number).alias("kind_no"), r["end"].alias("end"))
    found = F.transform(F.filter(rows, lambda r: r["test"] >= rule.least), span).cast(SPAN)
    return F.when(text.rlike(rule.hint), found).otherwise(F.array().cast(SPAN))


def scan(blobs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Add ``spans``, ordered by start and then by the order of the rules."""
    body = F.coalesce(F.col(text), F.lit(""))
    every = F.concat(*(_spans(body, rule, i) for i, rule in enumerate(rules)))
    return blobs.withColumn("spans", F.array_sort(every))


LEDGER = f"blob string, rule_version string, spans {SPAN}"


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


class Ledger:
    """A ledger stored in ``folder``, one subfolder per append.

    An append is written whole under a name of its own before it counts, so a
    run that dies adds nothing and may be repeated; a pair that two runs scan
    at once is stored twice and read once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def rows(self) -> DataFrame:
        """All entries, one per (blob, rule version)."""
        try:
            found = self.spark.read.schema(f"{LEDGER}, run string").option("basePath", self.folder).parquet(f"{self.folder}/run=*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty_ledger(self.spark)
        return found.drop("run")

    def append(self, entries: DataFrame) -> None:
        entries.write.parquet(f"{self.folder}/run={uuid.uuid4().hex}")

    def update(self, versions: DataFrame, rules=RULES) -> None:
        """Scan the blobs of ``versions`` that this rule version lacks, and store them."""
        self.append(new_entries(versions, self.rows(), rules))


def address(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(
        F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob")
    )


def new_entries(versions: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows for the blobs of ``versions`` that this rule version lacks."""
    version = rule_version(rules)
    known = ledger.filter(F.col("rule_version") == version).select("blob").distinct()
    unseen = versions.groupBy("blob").agg(F.min("path").alias("path")).join(known, "blob", "left_anti")
    unseen = unseen.select(F.col("blob").alias("b"), F.col("path").alias("p")).hint("shuffle_hash")
    chosen = versions.join(unseen, (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p")))
    # a path with equal versions gives equal rows: one stays
    found = scan(chosen.select("blob", "text"), rules).select("blob", "spans").dropDuplicates(["blob"])
    return found.select("blob", F.lit(version).alias("rule_version"), "spans")


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """One row per version with its spans, from the ledger of this rule version."""
    with_any = ledger.filter((F.col("rule_version") == rule_version(rules)) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    return versions.select("path", "blob").join(with_any, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def digest(found: DataFrame, rules=RULES) -> DataFrame:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    label = F.array_join(
        F.transform("spans", lambda s: F.concat_ws(":", kinds[s["kind_no"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of_kind = lambda i: F.size(F.filter("spans", lambda s: s["kind_no"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{r.kind}") for i, r in enumerate(rules)]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(label, 256).alias("base_sha256"), label.alias("spans"))


def op3_secret_ledger(spark, sf_dir: str) -> DataFrame:
    """The table's findings by way of a stored ledger, new for this run."""
    versions = address(documents(spark, sf_dir))
    ledger = Ledger(spark, fresh_folder(spark, "ledger"))
    ledger.update(versions)
    return digest(findings_by_path(versions, ledger.rows()))


def _sql_spans(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    return f"""
      SELECT doc_id, {number} AS kind_no, '{kind}' AS kind, b AS span_start, b + s AS span_end FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda k:
                 coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0)
                 + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0)))::BIGINT AS b,
               unnest(list_transform(m, lambda x: length(x)))::BIGINT AS s,
               unnest(list_transform(t, lambda x: length(x)))::BIGINT AS size
        FROM (SELECT doc_id, regexp_split_to_array(body, '{pattern}') AS g, regexp_extract_all(body, '{pattern}') AS m,
                     regexp_extract_all(body, '{pattern}', {group}) AS t FROM d)) WHERE size >= {least}"""


_ASSIGN = RULES[0].pattern.replace("'", "''")
OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
s AS ({_sql_spans("assign", 0, _ASSIGN, 2, 6)}
  UNION ALL {_sql_spans("access", 1, "AKIA[A-Z0-9]+", 0, 20)}
  UNION ALL {_sql_spans("hex", 2, "[0-9a-f]+", 0, 24)}),
a AS (
  SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
         count(*) FILTER (kind_no = 2) AS n_hex,
         string_agg(kind || ':' || span_start || ':' || span_end, ',' ORDER BY span_start, kind_no) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""
