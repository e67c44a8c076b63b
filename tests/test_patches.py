"""Information units, patches and padding."""

import json

from pyspark.sql import functions as F

from loomspan.functions import patches as p

SCHEMA = {"properties": {"location": {"type": "string", "description": "City name"}, "day": {"type": "string", "description": "date in ISO format"}}}
ROUTER = {
    "episode_id": "r1",
    "failure_class": "router_fail",
    "query": "Weather in Rome?",
    "function_pool": [{"name": "get_weather", "description": "Gets weather", "parameters": SCHEMA}, {"name": "get news", "description": "Gets news"}],
    "ground_truth_call": {"name": "get_weather", "accepted_arguments": {"location": ["Rome", ""], "day": [""]}},
    "predicted_call": {"name": "get news", "arguments": {"location": "Roma"}},
}
VALIDATOR = ROUTER | {"episode_id": "v1", "failure_class": "validator_fail", "predicted_call": {"name": "get_weather", "arguments": {"location": "Roma"}}}


def test_units():
    assert [u.id for u in p.units(ROUTER)] == ["IU-intent", "IU-fn-get_weather", "IU-fn-get_news", "IU-match"]
    assert [u.id for u in p.units(VALIDATOR)] == ["IU-param-location", "IU-param-day", "IU-format-day"]
    rows = p.parameters(VALIDATOR)
    assert rows[0]["accepted_values"] == ["Rome"] and rows[1]["accepted_values"] == [""] and rows[1]["predicted_value"] == "<missing>"
    assert p.parameters(VALIDATOR | {"ground_truth_call": {"name": "unknown", "accepted_arguments": {"location": "x"}}})[0]["description"] == "City name"


def test_texts():
    router = p.render(p.units(ROUTER), True, "STRUCT").split("\n")
    assert router[1] == "  Weather in Rome?" and router[3] == "  - name: get_weather | does: Gets weather" and router[-2] == "[STEP 4] Best match: get_weather"
    assert "For the user query 'Weather in Rome?', compare" in p.render(p.units(ROUTER), True, "NL")
    validator = p.render(p.units(VALIDATOR), False, "STRUCT").split("\n")
    assert validator[0] == "[FUNCTION] get_weather" and validator[3].startswith("[PARAM 1] name: location | type: string") and validator[-2] == "[FORMAT REQUIREMENTS]"
    assert p.render([], False, "NL") == "For function  and query '', extract the parameters as follows: ."


def test_padding():
    terms = p.forbidden(p.units(VALIDATOR))
    assert {"get_weather", "weather", "location", "string"} <= terms and "the" not in terms
    assert p.leaked("Use get_weather now", terms) and not p.leaked("forget_weathers", terms)
    for target in range(60, 120, 7):
        text = p.padded(p.units(ROUTER), "short text", target)
        assert p.within(p.n_tokens(text), target) and not p.leaked(text.split("\n\n")[1], p.forbidden(p.units(ROUTER)))


def test_spark(spark):
    failures = spark.createDataFrame([(json.dumps(f),) for f in (ROUTER, VALIDATOR)] + [(None,)], "record string")
    made = p.materialize(failures)
    rows = {r.patch_id: r for r in made.collect()}
    assert len(rows) == 6 and rows["STRUCT:r1"].component == "router" and rows["NL:v1"].parameter_names == ["location", "day"]
    assert all(rows[f"{f}:v1"].iu_ids == rows["STRUCT:v1"].iu_ids for f in p.FAMILIES)
    episodes = spark.createDataFrame(
        [("a", "get_weather", "get news", ["x"], ["location"]), ("b", "get_weather", "y", ["x"], ["other"]), ("c", "other", "get news", ["get news"], ["day"])],
        "episode_id string, gt_name string, selected string, pool array<string>, params array<string>",
    )
    met = {(r.episode_id, r.patch_id) for r in p.relevant(made, episodes).collect()}
    assert met == {("a", f"{f}:{e}") for f in p.FAMILIES for e in ("r1", "v1")}
    text = spark.sql("SELECT array('x', 'y') AS t, 'q' AS q, '[]' AS f").select(p.prompt(*map(F.col, "tqf"))).first()[0]
    assert "[PATCH 2] y" in text

