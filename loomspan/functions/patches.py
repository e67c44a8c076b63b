"""Repair patches: information units of a failure, rendered in three families.

A failure is a record with query, function_pool, ground_truth_call (name and
accepted_arguments), predicted_call and failure_class. Rendering quotes values
as Python does, so this runs in Arrow-batched Python on JSON records.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomspan.functions.calls import pad_to, text_udf
from loomspan.functions.text import FORMAT_WORDS, STOP_TERMS, TYPE_WORDS

FAMILIES = ("STRUCT", "NL", "NL-padded")

# The wording of units and patches, and the padding units.
RATIONALE = "The best function is the one whose description matches the user intent."
RULE = "Extract {name} as type {type} using the query and schema; accepted value(s): {accepted_values}; predicted value: {predicted_value}."
REQUIREMENT = "{name} must follow type {type}; schema note: {description}"
NO_SCHEMA_REQUIREMENT = "Use the required format for {name}."
ROUTER_STRUCT = (
    "[STEP 1] User wants to:\n  {query}\n[STEP 2] Candidate functions and what each does:\n{functions}"
    "[STEP 3] Model selected: {selected}\n[STEP 4] Best match: {best}\n[WHY] {rationale}"
)
ROUTER_STRUCT_FUNCTION = "  - name: {name} | does: {description}\n"
ROUTER_NL = (
    "For the user query {query!r}, compare these candidate functions: {functions}. "
    "The model selected {selected}, while the best matching function is {best} because {rationale}"
)
ROUTER_NL_FUNCTION = "{name} does {description}"
VALIDATOR_STRUCT = "[FUNCTION] {function}\n[QUERY] {query}\n[PARAMETERS]"
VALIDATOR_STRUCT_PARAMETER = (
    "[PARAM {index}] name: {name} | type: {type} | description: {description} | accepted: {accepted_values} | "
    "predicted: {predicted_value} | rule: {rule}"
)
VALIDATOR_STRUCT_FORMATS = "[FORMAT REQUIREMENTS]"
VALIDATOR_STRUCT_FORMAT = "[FORMAT] parameter: {name} | requirement: {requirement}"
VALIDATOR_NL = "For function {function} and query {query!r}, extract the parameters as follows: {parameters}."
VALIDATOR_NL_PARAMETER = "{name} has type {type}, description {description!r}, accepted value {accepted_values}, predicted value {predicted_value}, and rule {rule}"
VALIDATOR_NL_FORMAT = "Format requirement for {name}: {requirement}."
PADDING = (
    "Please pause briefly before continuing.",
    "Maintain a neutral posture.",
    "Proceed with careful neutral consideration.",
    "Keep the wording concise and orderly.",
    "Pause.",
    ".",
)
MATCH_WORDS = ("function", "intent", "match", "selected", "best")

TOKEN = re.compile(r"\w+|[^\w\s]")
TERM = re.compile(r"[A-Za-z][A-Za-z0-9_./:-]*")
NEEDS_FORMAT = re.compile(FORMAT_WORDS)


@dataclass
class Unit:
    kind: str
    suffix: str
    content: dict
    #: Fields whose words, or whose identifier pieces, padding must not contain.
    words: tuple = ()
    names: tuple = ()

    @property
    def id(self) -> str:
        return f"IU-{self.suffix}"


@dataclass
class Patch:
    patch_id: str
    family: str
    component: str
    trigger_episode_id: str
    target_function: str
    selected_function: str
    parameter_names: list = field(default_factory=list)
    patch_text: str = ""
    token_count: int = 0
    iu_ids: list = field(default_factory=list)


PATCH = (
    "patch_id string, family string, component string, trigger_episode_id string, target_function string, selected_function string, "
    "parameter_names array<string>, patch_text string, token_count int, iu_ids array<string>"
)


def n_tokens(text: str) -> int:
    return len(TOKEN.findall(text))


def safe_suffix(value) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", str(value)).strip("_") or "unknown"


def is_router(failure: dict) -> bool:
    return failure.get("failure_class") == "router_fail"


def _truth(failure: dict) -> dict:
    return failure.get("ground_truth_call") or {}


def _properties(failure: dict) -> dict:
    """The parameter schemas of the true function, or of the pool's first one."""
    pool = failure.get("function_pool") or [{}]
    own = [f for f in pool if isinstance(f, dict) and f.get("name") == _truth(failure).get("name")]
    function = (own or pool)[0]
    return (((function.get("parameters") or {}).get("properties")) or {}) if isinstance(function, dict) else {}


def parameters(failure: dict) -> list[dict]:
    """Type, description, accepted and predicted value of each accepted parameter."""
    made, schemas = [], _properties(failure)
    predicted = (failure.get("predicted_call") or {}).get("arguments", {})
    for name, accepted in (_truth(failure).get("accepted_arguments") or {}).items():
        schema = schemas.get(name, {})
        known = schema if isinstance(schema, dict) else {}
        filled = [v for v in accepted if v != ""] if isinstance(accepted, list) else []
        row = {
            "name": name,
            "type": known.get("type", "unknown"),
            "description": known.get("description", ""),
            "accepted_values": filled or accepted,
            "predicted_value": predicted.get(name, "<missing>"),
        }
        row["rule"] = RULE.format(**row)
        note = f"{name} {known.get('type', '')} {known.get('description', '')}"
        if NEEDS_FORMAT.search(note) or known.get("enum"):
            row["requirement"] = (REQUIREMENT if isinstance(schema, dict) else NO_SCHEMA_REQUIREMENT).format(**row).strip()
        made.append(row)
    return made


def units(failure: dict) -> list[Unit]:
    """The information that every family of patches must carry, in order."""
    if is_router(failure):
        pool = [f for f in failure.get("function_pool") or [] if isinstance(f, dict)]
        made = [Unit("intent", "intent", {"query": failure.get("query", "")}, words=("query",))]
        for f in pool:
            content = {"name": f.get("name", ""), "description": f.get("description", "")}
            made.append(Unit("candidate_function", f"fn-{safe_suffix(content['name'])}", content, ("description",), ("name",)))
        match = {"selected": (failure.get("predicted_call") or {}).get("name", "<parse_error>"), "best": _truth(failure).get("name", ""), "rationale": RATIONALE}
        return [*made, Unit("match", "match", match, names=("selected", "best"))]
    made, owner = [], {"function": _truth(failure).get("name", ""), "query": failure.get("query", "")}
    for row in parameters(failure):
        made.append(
            Unit("parameter", f"param-{safe_suffix(row['name'])}", owner | row, ("type", "description", "accepted_values", "predicted_value"), ("function", "name"))
        )
        if "requirement" in row:
            made.append(Unit("format", f"format-{safe_suffix(row['name'])}", row, ("requirement",), ("name",)))
    return made


def of_kind(made: list[Unit], kind: str) -> list[dict]:
    return [u.content for u in made if u.kind == kind]


def render(made: list[Unit], router: bool, family: str) -> str:
    struct = family == "STRUCT"
    if router:
        line, between, whole = (ROUTER_STRUCT_FUNCTION, "", ROUTER_STRUCT) if struct else (ROUTER_NL_FUNCTION, "; ", ROUTER_NL)
        functions = between.join(line.format(**f) for f in of_kind(made, "candidate_function"))
        return whole.format(**of_kind(made, "intent")[0], **of_kind(made, "match")[0], functions=functions)
    rows, formats = of_kind(made, "parameter"), of_kind(made, "format")
    owner = rows[0] if rows else {"function": "", "query": ""}
    owner = {k: owner[k] for k in ("function", "query")}
    if struct:
        lines = [VALIDATOR_STRUCT.format(**owner), *(VALIDATOR_STRUCT_PARAMETER.format(index=i, **r) for i, r in enumerate(rows, 1))]
        return "\n".join(lines + ([VALIDATOR_STRUCT_FORMATS, *(VALIDATOR_STRUCT_FORMAT.format(**r) for r in formats)] if formats else []))
    text = VALIDATOR_NL.format(**owner, parameters="; ".join(VALIDATOR_NL_PARAMETER.format(**r) for r in rows))
    return " ".join([text, *(VALIDATOR_NL_FORMAT.format(**r) for r in formats)])


# ---- padding ------------------------------------------------------------


def words_in(value) -> set[str]:
    return {w.lower() for w in TERM.findall(str(value)) if len(w) >= 3}


def names_in(value) -> set[str]:
    words = words_in(value)
    return words | {p for w in words for p in re.split(r"[^a-z0-9]+", w) if len(p) >= 3}


def forbidden(made: list[Unit]) -> set[str]:
    """Terms by which padding would carry information."""
    found: set[str] = set()
    for unit in made:
        for key in unit.words:
            found |= words_in(unit.content.get(key, ""))
        for key in unit.names:
            found |= names_in(unit.content.get(key, ""))
        found.update(MATCH_WORDS if unit.kind == "match" else TYPE_WORDS if unit.kind in ("parameter", "format") else ())
    return found - set(STOP_TERMS)


def leaked(text: str, terms: set[str]) -> list[str]:
    low = text.lower()
    return sorted(t for t in terms if re.search(rf"(?<![a-z0-9_]){re.escape(t)}(?![a-z0-9_])", low))


def padded(made: list[Unit], base: str, target: int, tolerance: float = 0.05) -> str:
    """The text brought within the tolerance of the target by padding without information."""
    terms = forbidden(made)
    safe = [u for u in PADDING if u == "." or not leaked(u, terms)]
    filling = " ".join(pad_to(n_tokens(base), target, [(u, n_tokens(u)) for u in safe], tolerance))
    return f"{base}\n\n{filling}" if filling else base


def within(count: int, target: int, tolerance: float = 0.05) -> bool:
    return target * (1 - tolerance) <= count <= target * (1 + tolerance)


def patches(failure: dict) -> list[Patch]:
    """One patch of each family; raises if the padded one misses the structured one's length."""
    made, router = units(failure), is_router(failure)
    texts = {f: render(made, router, f) for f in ("STRUCT", "NL")}
    target = n_tokens(texts["STRUCT"])
    texts["NL-padded"] = padded(made, texts["NL"], target)
    if not within(n_tokens(texts["NL-padded"]), target):
        raise ValueError(f"{failure['episode_id']}: {n_tokens(texts['NL-padded'])} tokens for {target}")
    return [
        Patch(
            f"{family}:{failure['episode_id']}",
            family,
            "router" if router else "validator",
            failure["episode_id"],
            _truth(failure).get("name", ""),
            (failure.get("predicted_call") or {}).get("name", ""),
            list(_truth(failure).get("accepted_arguments") or {}),
            texts[family],
            n_tokens(texts[family]),
            [u.id for u in made],
        )
        for family in FAMILIES
    ]


# The rule that a bundle gives each class of failure.
REPAIR_RULES = {
    True: "Choose the candidate function whose description best matches the user intent.",
    False: "Fill every required parameter with the value and type indicated by the query and schema.",
}


def bundle(failure: dict) -> dict:
    """All that a patch of either family may say of a failure: what it is about, its units, and the rule for its class."""
    made, router, truth, got = units(failure), is_router(failure), _truth(failure), failure.get("predicted_call") or {}
    out = {key: failure.get(key) for key in ("episode_id", "split", "failure_class")} | {"user_query": failure.get("query", "")}
    out |= {"iu_set": [{"id": u.id, "kind": u.kind, "content": u.content} for u in made], "iu_ids": [u.id for u in made], "repair_rule": REPAIR_RULES[router]}
    if router:
        pool = [u.content for u in made if u.kind == "candidate_function"]
        return out | {"candidate_functions": pool, "model_selected": got.get("name", "<parse_error>"), "gt_function": truth.get("name", "")}
    return out | {"function_name": truth.get("name", ""), "parameters": parameters(failure), "gt_arguments": truth.get("accepted_arguments") or {}, "predicted_arguments": got.get("arguments") or {}}


# ---- as Spark operators -------------------------------------------------


def materialize(failures: DataFrame, record: str = "record") -> DataFrame:
    """Patches of all families from a column of JSON failure records."""

    def run(batches):
        for batch in batches:
            rows = [asdict(p) for text in batch[record] if text for p in patches(json.loads(text))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PATCH.split(", ")])

    return failures.select(record).mapInPandas(run, PATCH)


def bundles(failures: DataFrame, record: str = "record") -> DataFrame:
    """The rows with ``bundle``: the information bundle of each failure record, as JSON."""
    run = text_udf(lambda s: json.dumps(bundle(json.loads(s)), ensure_ascii=False, sort_keys=True), "string", None)
    return failures.withColumn("bundle", run(record))


def relevance() -> Column:
    """Whether patch ``p`` concerns episode ``e`` of its target function.

    Episodes have gt_name, selected, pool (names) and params.
    """
    router = (F.col("p.selected_function") == F.col("e.selected")) | F.array_contains("e.pool", F.col("p.selected_function"))
    return F.when(F.col("p.component") == "router", router).otherwise(F.arrays_overlap("e.params", "p.parameter_names"))


def relevant(patches_df: DataFrame, episodes: DataFrame) -> DataFrame:
    """Pairs of an episode and a patch that concerns it: an equi-join on the function and a residual test."""
    p, e = patches_df.alias("p"), episodes.alias("e")
    return p.join(e, (F.col("p.target_function") == F.col("e.gt_name")) & relevance()).select("e.episode_id", "p.patch_id", "p.token_count")


def relevant_counts(patches_df: DataFrame, episodes: DataFrame) -> DataFrame:
    """(episode_id, n_relevant) without the pairs: patches and episodes of one shape are counted and met once."""
    shape = ["target_function", "component", "selected_function", "parameter_names"]
    kinds = patches_df.groupBy(*shape).agg(F.count("*").alias("n")).alias("p")
    keys = ["gt_name", "selected", "pool", "params"]
    forms = episodes.select(*keys).distinct()
    met = forms.alias("e").join(kinds, (F.col("p.target_function") == F.col("e.gt_name")) & relevance()).groupBy(*(F.col(f"e.{k}") for k in keys)).agg(F.sum("n").alias("n_relevant"))
    return episodes.select("episode_id", *keys).join(met, keys, "left").select("episode_id", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))


def overlap_counts(rows: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Rows with ``n_met``: how many rows (itself included) of the same keys share a value of the set ``values`` (sorted).

    Rows with equal sets are one class; classes meet on shared values, so the
    pairs are those of distinct sets, not of rows.
    """
    kinds = rows.groupBy(*keys, values).agg(F.count("*").alias("n"))
    each = kinds.select(*keys, values, "n", F.explode(values).alias("_v"))
    other = each.select(*keys, F.col(values).alias("_other"), F.col("n").alias("_n"), "_v")
    pairs = each.join(other, [*keys, "_v"]).select(*keys, values, "_other", "_n").distinct()
    met = pairs.groupBy(*keys, values).agg(F.sum("_n").alias("n_met"))
    return rows.join(met, [*keys, values], "left").withColumn("n_met", F.coalesce("n_met", F.lit(0)))


# The prompt's wording.
PROMPT_PARTS = ("Patches:\n", "\n\nQuery: ", "\nFunctions: ", "\nCall:")
NO_PATCHES = "None."


def prompt(patch_texts: Column, query: Column, functions: Column) -> Column:
    """Numbered patches, the query and the function documents."""
    numbered = F.array_join(F.transform(patch_texts, lambda t, i: F.concat(F.lit("[PATCH "), (i + 1).cast("string"), F.lit("] "), t)), "\n\n")
    shown = F.when(F.size(patch_texts) > 0, numbered).otherwise(F.lit(NO_PATCHES))
    a, b, c, d = map(F.lit, PROMPT_PARTS)
    return F.concat(a, shown, b, query, c, functions, d)


def prompt_text(failure: dict, texts: list[str]) -> str:
    """The same prompt for a failure record."""
    a, b, c, d = PROMPT_PARTS
    shown = "\n\n".join(f"[PATCH {i}] {t}" for i, t in enumerate(texts, 1)) or NO_PATCHES
    return f"{a}{shown}{b}{failure.get('query', '')}{c}{json.dumps(failure.get('function_pool', []), ensure_ascii=False)}{d}"
