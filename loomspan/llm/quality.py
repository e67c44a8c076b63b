"""Quality rules: a threshold table compiled into one Spark projection.

The signals of a document (length, symbol, stop-word, line and repetition
figures) are array and string expressions over its own row, so the operator
has no shuffle, no user function and no state: it scales with the scan.

Defined results: a null, empty or blank text has no words, every count is 0
and the document fails the base rule. Ties and repeated rows do not matter
(each row is judged alone); an empty table gives an empty result; columns of
the input that clash with a result column are replaced by the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomspan.llm.common import BLANKS, documents, whole_row, words_of

SYMBOLS = r"[^#*$%&|<>]+"

# Frequent function words of the four corpus languages.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are at from "
    "le la les de des et un une en que qui du dans pour est au par "
    "der die das und den von zu ist nicht mit sich auf ein eine dem "
    "el los las y del se por con no una su para es al"
).split()


@dataclass(frozen=True)
class Rule:
    """One row of the threshold table: ``low <= signal <= high`` must hold.

    ``over`` divides the signal (a null ratio, from a zero divisor, passes).
    """

    name: str
    signal: str
    low: float | None = None
    high: float | None = None
    over: str | None = None

    def verdict(self) -> Column:
        value = F.col(self.signal).cast("double")
        if self.over:
            value = F.try_divide(value, F.col(self.over).cast("double"))
        tests = [value >= self.low] if self.low is not None else []
        tests += [value <= self.high] if self.high is not None else []
        test = tests[0]
        for other in tests[1:]:
            test = test & other
        return F.coalesce(test, F.lit(True))


RULES = (
    Rule("word_length", "word_chars", low=1.5, high=15.0, over="n_words"),
    Rule("symbols", "n_symbols", high=0.1, over="n_words"),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("repeated_lines", "n_dup_lines", high=0.4, over="n_lines"),
    Rule("lettered_words", "n_letters", low=0.5, over="word_chars"),
)


def _window(words: Column, i: Column) -> Column:
    return F.struct(words[i], words[i + 1], words[i + 2])


def _covered(positions: Column) -> Column:
    """Words under three-word windows that start at the sorted positions."""
    step = F.transform(
        positions, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(positions, j + 1) - p, F.lit(3)).cast("int"))
    )
    return F.aggregate(step, F.lit(0).cast("long"), lambda total, x: total + x)


def _fast_positions(packed: Column, bits: Column) -> Column:
    """Entries whose neighbour has the same key (a null neighbour is none)."""
    key = lambda x: F.call_function("shiftright", x, bits)
    return F.filter(
        packed,
        lambda x, j: (key(x) == key(F.get(packed, j + 1))) | (key(x) == key(F.get(packed, j - 1))),
    )


def with_signals(docs: DataFrame, text: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """Add the signal columns the rules refer to.

    Repetition: each window's 64-bit hash keeps its upper bits and gets the
    position in its lower ones, so one primitive sort brings equal windows
    together. Where neighbours of equal hash differ in words (a collision),
    that document alone is counted again by sorting the words themselves.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    out = docs.withColumns({"_words": words_of(body), "_lines": lines})
    n = F.size("_words")
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "_bits": F.ceil(F.log2(F.greatest(n, F.lit(1)) + 1)).cast("int"),
            "_hashes": F.when(
                n > 2,
                F.transform(
                    F.slice("_words", 1, F.greatest(n - 2, F.lit(0))),
                    lambda x, i: F.xxhash64(x, F.col("_words")[i + 1], F.col("_words")[i + 2]),
                ),
            ).otherwise(F.array().cast("array<long>")),
        }
    )
    out = out.withColumn(
        "_packed",
        F.sort_array(
            F.transform(
                "_hashes",
                lambda h, i: F.call_function("shiftleft", F.call_function("shiftrightunsigned", h, F.col("_bits")), F.col("_bits"))
                .bitwiseOR(i.cast("long")),
            )
        ),
    )
    out = out.withColumn("_again", _fast_positions(F.col("_packed"), F.col("_bits")))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1).cast("int")
    same_key = lambda a, b: F.call_function("shiftright", a, F.col("_bits")) == F.call_function("shiftright", b, F.col("_bits"))
    clash = F.exists(
        F.sequence(F.lit(1), F.greatest(F.size("_again") - 1, F.lit(1))),
        lambda j: F.coalesce(
            same_key(F.get("_again", j), F.get("_again", j - 1))
            & (_window(F.col("_words"), place(F.get("_again", j))) != _window(F.col("_words"), place(F.get("_again", j - 1)))),
            F.lit(False),
        ),
    )
    out = out.withColumn("_clash", (F.size("_again") > 1) & clash)
    exact = F.sort_array(
        F.transform(F.slice("_words", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.struct(_window(F.col("_words"), i).alias("w"), i.alias("i")))
    )
    out = out.withColumn("_exact", F.when(F.col("_clash"), exact))
    slow = F.filter(
        "_exact",
        lambda x, j: (x["w"] == F.get("_exact", j - 1)["w"]) | (x["w"] == F.get("_exact", j + 1)["w"]),
    )
    out = out.withColumn(
        "_places",
        F.when(F.col("_clash"), F.sort_array(F.transform(slow, lambda x: x["i"]))).otherwise(
            F.sort_array(F.transform("_again", place))
        ),
    )
    joined = F.array_join("_words", "")
    out = out.withColumns(
        {
            "word_chars": F.length(joined).cast("long"),
            "n_symbols": F.length(F.regexp_replace(body, SYMBOLS, "")).cast("long"),
            "n_letters": F.length(F.regexp_replace(joined, r"[^\p{L}]+", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _covered(F.col("_places")),
            "n_stop_words": F.size(F.array_intersect("_words", F.array(*map(F.lit, stop_words)))).cast("long"),
        }
    )
    return out.drop("_words", "_lines", "_bits", "_hashes", "_packed", "_again", "_clash", "_exact", "_places")


def judge(docs: DataFrame, rules=RULES, text: str = "text", min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Add the signals, ``base_failed``, ``failed_rules`` and ``kept``."""
    out = with_signals(docs, text)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    failed = F.array_compact(F.array(*(F.when(~r.verdict(), F.lit(r.name)) for r in rules)))
    out = out.withColumns({"base_failed": base, "failed_rules": failed})
    # the row id keeps a filter on ``kept`` above this projection: pushed below, it would repeat every signal
    return out.withColumn("kept", (F.monotonically_increasing_id() >= 0) & ~F.col("base_failed") & (F.size("failed_rules") == 0))


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select(*RESULT)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    if "text" not in docs.columns:
        return docs
    return judge(docs.select(whole_row(docs).alias("_row"), F.col("text"))).filter("kept").select("_row.*")


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
OP1_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
pos AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM pos),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM tri, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
s AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(array_to_string(words, ''), '[^\\p{{L}}]+', '', 'g'))::BIGINT AS n_letters,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(list_intersect(list_distinct(words), [{_STOPS}]))::BIGINT AS n_stop_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND word_chars BETWEEN 1.5 * n_words AND 15 * n_words AND n_symbols <= 0.1 * n_words
        AND n_stop_words >= 2 AND n_dup_lines <= 0.4 * n_lines AND n_letters >= 0.5 * word_chars) AS kept
FROM b
"""
