import pytest
from pyspark.sql import functions as F

from tidepool.errors import ConfigError, ValidationError
from tidepool.functions import ActionRange, number, orientation_of, tag_problems, two_level_action
from tidepool.operators.checks import CHECKS, Check, evaluate
from tidepool.operators.merge import merge_actions
from tidepool.operators.metrics import METRICS, relative_to_absolute
from tidepool.plans import config
from tidepool.plans.preview import actions_of
from tidepool.plans.selection import select


def actions(df, name, **settings):
    check = CHECKS[name].configured(settings)
    return [(r[f"{name}_action"], r[f"{name}_reason"]) for r in check.evaluate(df).collect()]


def test_numbers_are_null_safe(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in df.select(number("v")).collect()] == [1.5, None, None, None]


def test_missing_values_fire_only_decode_and_dimension(spark):
    df = spark.createDataFrame([("a", 0, None, None, float("nan"), None, None)], "image_id string, _pos long, decode_ok boolean, decode_error string, blur_score double, width int, height int")
    assert actions(df, "decode") == [("drop", "decode_error")]
    assert actions(df, "dimension") == [("drop", "smaller than 1x1")]
    assert actions(df, "blur") == [("keep", "")]


def test_quality_rows(spark):
    df = spark.createDataFrame([("ok", 200.0, 120.0, 20.0, 0.0), ("bad", 10.0, 5.0, 2.0, 1.0)], "image_id string, blur_score double, brightness_score double, contrast_score double, blank_score double")
    for n in ("blur", "brightness", "contrast"):
        assert [a for a, _ in actions(df, n)] == ["keep", "review"]
    assert [a for a, _ in actions(df, "blank")] == ["keep", "drop"]


def test_missing_columns_and_settings(spark):
    df = spark.createDataFrame([("a",)], "image_id string")
    with pytest.raises(ValidationError):
        CHECKS["blur"].configured().evaluate(df)
    with pytest.raises(ConfigError):
        CHECKS["blur"].configured({"no_such": 1})
    with pytest.raises(ConfigError):
        CHECKS["exact_duplicate"].configured({"keep": "last"})
    with pytest.raises(TypeError):
        CHECKS["blur"].configured({"min_score": "high"}).columns()


@pytest.mark.parametrize("text", ["[0, 1", "0, 1]", "[a, 1]", "[0, inf]", "[nan, 1]", "[2, 1]", None])
def test_bad_intervals(text):
    with pytest.raises(ConfigError):
        ActionRange.parse(text)


def test_rules(spark):
    df = spark.createDataFrame([("a", 60.0), ("b", 135.0), ("c", 240.0), ("d", None)], "image_id string, blur_score double")
    got = [r[0] for r in df.select(two_level_action("blur_score", "[0, 0.3]", "(0.3, 0.6]", (0.0, 300.0))).collect()]
    assert got == ["drop", "review", "keep", "keep"]
    check = CHECKS["blur"].configured({"rules": {"drop": "[0, 0.3]", "review": "(0.3, 0.6]"}})
    assert [r["blur_action"] for r in check.evaluate(df).collect()] == ["drop", "review", "keep", "keep"]


def test_merge_order(spark):
    rows = [("1", "drop", "demo failed", "keep", ""), ("2", "review", "borderline", "restricted", "policy hit"), ("3", "keep", "", "keep", ""), ("4", "odd", "x", " ", "y")]
    df = spark.createDataFrame(rows, "image_id string, demo_check_action string, demo_check_reason string, policy_check_action string, policy_check_reason string")
    checks = [Check("demo_check", "quality", (), {"action": "drop"}, lambda c: (F.lit(True), F.lit(""))).configured(), Check("policy_check", "content", (), {"action": "drop"}, lambda c: (F.lit(True), F.lit(""))).configured()]
    got = [tuple(r) for r in merge_actions(df, checks).select("final_action", "final_reason", "triggered_operator_names").collect()]
    assert got == [("drop", "demo failed", "quality.demo_check"), ("restricted", "policy hit; borderline", "content.policy_check;quality.demo_check"), ("keep", "", ""), ("keep", "", "")]


def test_relative_values():
    assert relative_to_absolute("blur", 0.5) == 150
    for bad in (("blur", 1.5), ("decode", 0.5), ("none", 0.5)):
        with pytest.raises(ConfigError):
            relative_to_absolute(*bad)
    assert set(METRICS) == set(CHECKS)


def test_tags_and_orientation(spark):
    df = spark.createDataFrame([(["a/b", "", "a//b", " a", "a/ b"], 3, 2)], "tags array<string>, w int, h int")
    r = df.select(tag_problems("tags"), orientation_of("w", "h")).first()
    assert r[0] == ["", "a//b"] and r[1] == "landscape"


def test_selection():
    assert len(select(["ALL"])) == 17
    assert [c.name for c in select(["duplicate"])] == ["exact_duplicate", "perceptual_duplicate", "semantic_duplicate"]
    merged = select(["blur", {"blur": {"min_score": 5.0}}, {"BLUR": {"action": "drop"}}])
    assert len(merged) == 1 and dict(merged[0].config) == {"min_score": 5.0, "action": "drop"}
    for bad in (["quality.blur"], ["nothing"], [{"blur": 3}], [3]):
        with pytest.raises(ConfigError):
            select(bad)
    own = Check("blur", "quality", ("blur_score",), {"action": "drop"}, lambda c: (F.lit(True), F.lit("")))
    with pytest.raises(ConfigError):
        select([own])
    assert select([own], {"blur": {"override": True}})[0].check is own


def test_files():
    made = config.from_toml('[operators]\nblur = { min_score = 5.0 }\n[operators.noise]\nmax_score = 0.5\n[operators.noise.runtime]\nbatch_size = 7\n[runtime]\nbatch_size = 100\n')
    assert [c.name for c in made.checks] == ["blur", "noise"] and made.policies["noise"].batch_size == 7
    assert config.from_toml(config.template(made)).checks == made.checks
    assert [c.name for c in config.from_toml('[select]\nuse = ["quality"]\nblur = { min_score = 1.0 }\n').checks][:1] == ["blur"]
    assert [c.name for c in config.from_toml('[select]\ncategories = ["QUALITY"]\n').checks] == [c.name for c in config.from_toml('[select]\ncategories = "quality"\n').checks] == [n for n, c in CHECKS.items() if c.category == "quality"]
    assert [c.name for c in config.from_toml("[runtime]\nbatch_size = 9\n").checks] == list(CHECKS)
    recipe = config.from_yaml("version: 1\noperators:\n - use: quality.blur\n   with: {min_score: 3.0}\n   drop: {range: '[0, 0.1]'}\n")
    assert recipe.checks[0].config["min_score"] == 3.0 and recipe.checks[0].rule_ranges() == {"drop": "[0, 0.1]"}
    for bad in ("[select]\nuse=['blur']\n[operators]\nblur={}", "[x]\n", "[select]\nuse=[]", "[select]\ncategories=[1]", "[select]\ncategories=['no_such']", "[select]\nuse=['blur']\n[runtime]\nbatch_size=0", "[select]\nuse=['blur']\n[runtime]\nodd=1"):
        with pytest.raises(ConfigError):
            config.from_toml(bad)
    for bad in ("version: 2\noperators: [{use: blur}]", "version: 1\noperators: []", "version: 1\noperators: [{with: {}}]"):
        with pytest.raises(ConfigError):
            config.from_yaml(bad)


def test_action_filters():
    assert actions_of("clean") == ["keep"] and actions_of(["Review", "drop"]) == ["review", "drop"] and actions_of([]) is None and actions_of("full") is None
    for bad in (["full", "keep"], ["odd"], ["restricted"]):
        with pytest.raises(ValueError):
            actions_of(bad)


def test_duplicate_checks_keep_the_first(spark):
    rows = [("b", 1, "g", 2), ("a", 0, "g", 2), ("c", 2, "", 1), ("d", 3, None, None)]
    df = spark.createDataFrame(rows, "image_id string, _pos long, exact_duplicate_group_id string, exact_duplicate_count long")
    got = {r["image_id"]: r["exact_duplicate_action"] for r in evaluate(df, [CHECKS["exact_duplicate"].configured()]).collect()}
    assert got == {"a": "keep", "b": "drop", "c": "keep", "d": "keep"}
