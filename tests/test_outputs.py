import pytest
from pyspark.sql import functions as F

from sparkrubric.functions import outputs as op
from sparkrubric.operators import checks as ck
from sparkrubric.operators import scoring as sc

CASES = [
    ('text\n```json\n{"day1": ["a"]}\n```', "text", True, False),
    ('unu {"a": 1} doi {"b": {"c": 2}} coada', 'unu {"a": 1} doi', True, False),
    ('text {"a": 1} }', 'text {"a": 1} }', False, False),
    ('text {"a": 1} {', 'text {"a": 1} {', False, False),
    ('text {"a": [1, 2,],}', "text", False, True),
    ('text {"a": 1, // nota\n "b": 2}', "text", False, True),
    ("fără plan", "fără plan", False, False),
    ('{"answer": "x"} apoi', "", True, False),
    ('text {"a": }', "text", False, False),
]


def test_parser(spark):
    df = spark.createDataFrame([(n, c[0]) for n, c in enumerate(CASES)], "id int, output string")
    rows = op.parse_outputs(df).orderBy("id").collect()
    got = [(r.explanation, r.format_ok, r.repaired) for r in rows]
    assert got == [c[1:] for c in CASES]


def test_cells(spark):
    text = 'x {"day1": ["a", 3], "day2": null, "s": "null", "t": "", "n": 0, "o": {"k": 1}}'
    cells = sc.parse_run(spark.createDataFrame([(text,)], "output string")).select(F.inline("cells")).collect()
    kinds = {c.key: (c.kind, c.truthy, c.is_null_word) for c in cells}
    assert kinds["day1"] == ("list", True, False) and kinds["day2"] == ("null", False, False)
    assert kinds["s"] == ("string", True, True) and kinds["t"] == ("string", False, False)
    assert kinds["n"] == ("other", False, False) and kinds["o"] == ("other", True, False)


def check(spark, name, plan, **params):
    df = sc.parse_run(spark.createDataFrame([(1, plan)], "id int, output string"))
    return ck.run_check(op.plan_items(df, ["id"]), ["id"], name, **params).first().satisfied


@pytest.mark.parametrize(
    ("name", "plan", "params", "want"),
    [
        ("check_days_non_empty", '{"day1": ["a"], "day2": ["b"]}', {"num_days": 2}, True),
        ("check_days_non_empty", '{"day1": ["a"], "day2": []}', {"num_days": 2}, False),
        ("check_min_activities_per_day", '{"day1": []}', {}, False),
        ("check_max_activities_per_day", '{"day1": null}', {}, False),
        ("check_max_activities_per_day", "{}", {}, True),
        ("check_no_duplicates", '{"day1": ["a"], "day2": ["a"]}', {}, False),
        ("check_max_total_appointments", '{"Luni_dimineață": "a", "Luni_seara": "null", "Joi_x": null}', {"max_total": 1}, True),
        ("check_no_back_to_back", '{"Luni_dimineață": "a", "Luni_după-amiaza": "b"}', {}, False),
        ("check_spread_across_days", '{"Luni_a": "x", "Joi_a": "y"}', {}, True),
        ("check_all_meals_filled", '{"day1_breakfast": "a", "day1_pranz": "b", "day1_cina": "c"}', {"num_days": 1}, True),
        ("check_exact_answer_value", '{"answer": " Euro. "}', {"expected": "euro"}, True),
        ("check_no_slot_overlaps", "{}", {}, True),
    ],
)
def test_checks(spark, name, plan, params, want):
    assert check(spark, name, "text " + plan, **params) is want


def test_unknown_check(spark):
    with pytest.raises(ValueError, match="Unknown constraint"):
        check(spark, "check_nothing", "{}")


def test_score_formulas(spark):
    cols = "constraints_satisfied int, constraints_total int, format_satisfied int, format_total int, explanation_chars int"
    rows = sc.understanding(spark.createDataFrame([(2, 3, 5, 5, 80), (2, 3, 5, 5, 20)], cols)).collect()
    assert rows[0].U == pytest.approx(0.401852, abs=1e-6) and rows[1].U == pytest.approx(0.200926, abs=1e-6)


def test_repeated_keys_and_brace_paths(spark):
    texts = ['text {"day1": ["a"], "day1": ["b"]}', 'x {"a": {"b": 1}} y', "} { no", 'only {"a": 1} end', "{", "a } b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, output string")
    rows = {r.id: r for r in op.parse_outputs(df).select("id", "plan_json", "explanation", F.to_json("plan").alias("plan")).collect()}
    assert rows[0].plan == '{"day1":["b"]}'
    assert rows[1].plan_json == '{"a": {"b": 1}}' and rows[1].explanation == "x"
    assert rows[3].plan_json == '{"a": 1}' and rows[3].explanation == "only"
    assert all(rows[i].plan is None for i in (2, 4, 5))
