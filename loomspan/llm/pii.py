"""Personal data by bootstrapped contextual extraction.

Exact matchers (email, ip, card, phone) give the seed entities. Every seed, and
every other identifier-like token, is an instance; the words around it are
lexical patterns. Over the pattern-instance graph Spark scores in rounds: a
pattern's confidence for a kind is the scored share of its instances, damped by
its support; an unseen instance's score is the noisy-or of its patterns, and
instances above the threshold join the seeds of the next round. What is found
in the last round is personal data at each of its places.

Graph edges are pre-aggregated (pattern, instance) rows; scores are joins and
sums, never collected lists, so a pattern with a third of all rows is split by
adaptive execution. Rounds are cut by checkpoints. Matchers take time linear in
the text.

Defined results: a null text is an empty one; null or repeated keys are fine
(spans belong to a key and text together); texts of any length are read whole, context words are taken at any distance; ties between kinds go to the first
listed; without seeds or in an empty table nothing is discovered; extra columns
do not matter. Added spans never overlap a base span.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomspan.llm.common import BATCH_ROWS, cut, documents, map_batches, whole_row

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 3.0
MIN_PATTERN = 0.5
MIN_INSTANCE = 0.6
#: Discovered spans up to which the pipeline stage broadcasts them.
BROADCAST_ROWS = 200_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9@]")
TOKEN_END = re.compile(r"\s|$")

SPAN = "struct<start:long,kind_no:int,end:long>"
SLOT = "struct<start:long,end:long,kind_no:int,instance:string,patterns:array<string>>"


def emails(text: str):
    """Leftmost matches: around each @, back to the run's start and on over the domain."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            free = match.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the exact matchers, ordered by start and kind."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _word(word: str) -> str:
    return re.sub(r"[0-9]", "0", word.lower())


def _before(text: str, start: int) -> list[str]:
    """The last two words before a place (fewer at the text's start), however far away they are."""
    wide = 128
    while True:
        window = text[max(0, start - wide) : start]
        words = window.split()
        if start <= wide:
            return words[-2:]
        if len(words) > 2:  # the first one may be cut
            return words[-2:]
        wide *= 4


def _after(text: str, end: int) -> str | None:
    """The first word after a place, however far away and long it is."""
    wide = 64
    while True:
        words = text[end : end + wide].split(None, 1)
        if len(words) == 2 or end + wide >= len(text):
            return words[0] if words else None
        wide *= 4


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical contexts of a place: two words before; a word on either side, or the text's start; a label before."""
    left = [_word(w) for w in _before(text, start)]
    right = _after(text, end)
    right = "$" if right is None else _word(right)
    made = []
    if len(left) == 2:
        made.append(f"2 {left[0]} {left[1]}")
    if left:
        made.append(f"1 {left[-1]} {right}")
        if left[-1][-1] in ":=#":
            made.append(f"0 {left[-1]}")
    elif not text[:start].strip():
        made.append(f"^ {right}")
    return made


def candidates(text: str, taken: list[tuple[int, int, int]]):
    """Identifier-like tokens outside the taken spans, of five characters or more: five digits or more, or an @."""
    done = 0
    while m := DIGIT.search(text, done):
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        done = TOKEN_END.search(text, m.end()).start()
        raw = text[start:done]
        core = raw.strip("\"'`.,;:!?()[]{}<>|*#$%&=")
        if len(core) < 5 or (len(_digits(core)) < 5 and "@" not in core):
            continue
        a = start + raw.index(core)
        b = a + len(core)
        if not any(s < b and e > a for s, _, e in taken):
            yield a, b, core


def _content(text: Column) -> Column:
    """What tells texts of one key apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, content (hash), base (spans) and slots (instances with patterns)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), _content(F.col(text)).alias("content"))
    kind = rows.schema["key"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind_no", pa.int32()), ("end", pa.int64())]))
    slot = pa.list_(
        pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind_no", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    )

    def run(batches):
        for batch in batches:
            base, slots = [], []
            for value in batch.column(1):
                body = value.as_py() or ""
                found = base_spans(body)
                own = [(a, b, k, body[a:b].lower(), patterns(body, a, b)) for a, k, b in found]
                own += [(a, b, None, core.lower(), patterns(body, a, b)) for a, b, core in candidates(body, found)]
                base.append([dict(zip(("start", "kind_no", "end"), s)) for s in found])
                slots.append([dict(zip(("start", "end", "kind_no", "instance", "patterns"), s)) for s in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(base, span), pa.array(slots, slot)], names=["key", "content", "base", "slots"]
            )

    return map_batches(rows, run, f"key {kind}, content long, base array<{SPAN}>, slots array<{SLOT}>", BATCH_ROWS)


def discover(slots: DataFrame, rounds: int | None = None) -> DataFrame:
    """(instance, kind_no, score) of instances that no exact matcher knows, after ``rounds`` or the first round without new ones."""
    edges = cut(
        slots.select("instance", "kind_no", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.min("kind_no").alias("kind_no"))
    )
    totals = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    seeds = edges.filter(F.col("kind_no").isNotNull()).select("instance", "kind_no", F.lit(1.0).alias("score")).distinct()
    unseen = edges.filter(F.col("kind_no").isNull()).join(seeds.select("instance"), "instance", "left_anti").select("pattern", "instance")
    found, n = None, 0
    for _ in itertools.count() if rounds is None else range(rounds):
        known = seeds if found is None else seeds.union(found)
        support = edges.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind_no").agg(F.sum("score").alias("support"))
        trust = support.join(totals, "pattern").withColumn("trust", F.col("support") / F.col("total") * (1 - 1 / (1 + F.col("support"))))
        good = trust.filter((F.col("support") >= MIN_SUPPORT) & (F.col("trust") >= MIN_PATTERN)).select("pattern", "kind_no", "trust")
        doubt = F.sum(F.log(1 - F.least("trust", F.lit(0.999))))
        scored = unseen.join(good, "pattern").groupBy("instance", "kind_no").agg((1 - F.exp(doubt)).alias("score"))
        best = scored.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind_no")).alias("k"))).alias("b"))
        best = best.select("instance", (-F.col("b.k")).alias("kind_no"), F.col("b.score").alias("score"))
        found = cut(best.filter(F.col("score") >= MIN_INSTANCE))
        before, n = n, found.count()
        if n <= before:
            break
    return found


def added_spans(marked: DataFrame, rounds: int | None = None) -> DataFrame:
    """(key, content, added): spans of discovered instances, per text."""
    slots = marked.select("key", "content", F.explode("slots").alias("s")).select("key", "content", "s.*")
    found = discover(slots, rounds).select("instance", F.col("kind_no").alias("new_kind"))
    placed = slots.filter(F.col("kind_no").isNull()).join(found, "instance")
    span = F.struct("start", F.col("new_kind").cast("int").alias("kind_no"), "end")
    return placed.groupBy("key", "content").agg(F.array_sort(F.collect_set(span)).alias("added"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, content, base and added spans of every row."""
    marked = cut(scan(docs, key, text))
    added = cut(added_spans(marked)).withColumnsRenamed({"key": "_key", "content": "_content"})
    out = marked.join(added, F.col("key").eqNullSafe(F.col("_key")) & (F.col("content") == F.col("_content")), "left")
    return out.select("key", "content", "base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")).alias("added"))


def _label(spans):
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind_no"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii_bootstrap(spark, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["kind_no"] == i)).cast("long")
    return found.select(
        F.col("key").alias("doc_id"),
        *(of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(_label(F.col("base")), 256).alias("base_sha256"),
        _label(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Replace spans (overlapping ones united) by the first one's kind in brackets."""
    made, at, end = [], 0, -1
    for start, kind, stop in sorted(spans):
        if start < end:
            end = at = max(end, stop)
            continue
        made += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end = stop
    return "".join([*made, text[at:]])


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with personal data in ``text`` masked."""
    added = cut(added_spans(cut(scan(docs, key, text))))
    if added.count() <= BROADCAST_ROWS:
        added = F.broadcast(added)
    found = added.select(F.col("key").alias("own"), F.col("content").alias("of"), "added")
    rows = docs.select(whole_row(docs, text).alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"), _content(F.col(f"`{text}`")).alias("content"))
    # by key and text, so neither a repeated key nor the missing one makes a large row
    joined = rows.join(found, F.col("key").eqNullSafe(F.col("own")) & (F.col("content") == F.col("of")), "left").select("row", "text", "added")

    def run(batches):
        for batch in batches:
            made = []
            for value, extra in zip(batch.column(1), batch.column(2)):
                body = value.as_py()
                if body:
                    spans = base_spans(body) + [(s["start"], s["kind_no"], s["end"]) for s in extra.as_py() or ()]
                    body = mask(body, spans) if spans else body
                made.append(body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["row", "text"])

    out = map_batches(joined, run, joined.drop("added").schema, BATCH_ROWS)
    return out.select(*(F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is masked; ``n_chars`` follows the text."""
    out = masked(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out
