from math import cos, pi

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import answer
from waymark.operators import metrics, order, rewards, rollout, scoring, tools
from waymark.plans import catalog


def test_empty_set_conventions(spark):
    rows = spark.createDataFrame([(["a"], ["a"]), ([], []), (None, None), (["a"], []), ([], ["a"]), (["a", "a", None], ["a", "b"])], "p array<string>, g array<string>")
    got = rows.select(scoring.set_f1(F.col("p"), F.col("g")).alias("strict"), scoring.set_f1(F.col("p"), F.col("g"), 1.0).alias("lenient")).collect()
    assert [r.strict for r in got] == [1.0, 0.0, 0.0, 0.0, 0.0, pytest.approx(2 / 3)]
    assert [r.lenient for r in got] == [1.0, 1.0, 1.0, 0.0, 0.0, pytest.approx(2 / 3)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sets(st.sampled_from("abcde")), st.sets(st.sampled_from("abcde"))), min_size=1, max_size=30))
def test_f1_equals_the_definition(spark, pairs):
    rows = spark.createDataFrame([(i, sorted(p), sorted(g)) for i, (p, g) in enumerate(pairs)], "i int, p array<string>, g array<string>")
    got = {r.i: r.f for r in rows.select("i", scoring.set_f1(F.col("p"), F.col("g")).alias("f")).collect()}
    for i, (p, g) in enumerate(pairs):
        both = len(p & g)
        assert got[i] == pytest.approx(2 * both / (len(p) + len(g)) if p and g else 0.0)
        assert 0 <= got[i] <= 1


def test_sizes_are_summed_in_dealt_parts(spark):
    # a key of very many items, a null key and a null item, rows that repeat, a flag that is unknown in one of them
    lines = [(0, i % 900, i % 900 % 2 == 0, i % 900 % 3 == 0) for i in range(1800)] + [(None, 1, True, False), (None, 1, None, True), (5, None, False, True), (5, 6, False, False)]
    rows = spark.createDataFrame(lines, "key int, item int, predicted boolean, gold boolean")
    expected = {(0, 150, 450, 300), (None, 1, 1, 1), (5, 0, 0, 1)}
    dealt = scoring.long_sizes(rows, "key", 7)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count(", 7), REPARTITION_BY_NUM") == 2
    assert {tuple(r) for r in dealt.collect()} == expected == {tuple(r) for r in scoring.long_sizes(rows, "key").collect()}


def test_set_scores_are_dealt_to_parts_that_grow(spark, monkeypatch):
    monkeypatch.setattr(order, "TASK_ROWS", 100)
    names = "a8_set_f1_strict_long a13_precision_recall a8_set_f1_strict_array a9_set_f1_lenient a11_multilevel_f1 a11_levels_apart a12_file_f1 a13_result_tool j1_set_intersection u3_intersection u4_distinct"
    for name in names.split():
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        # no shuffle of a fixed number of parts
        assert ", 60), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan, name


def test_multilevel_is_not_normalised(spark):
    changes = "array<struct<file:string,changes:struct<edited_modules:array<string>,edited_entities:array<string>>>>"
    rows = spark.createDataFrame([(["a"], ["a:C"], ["a:C.f"], [("a", (["a:C"], None))]), (["a"], [], [], None)], f"files array<string>, modules array<string>, entities array<string>, file_changes {changes}")
    built, parts = rewards.multilevel_localization()
    assert [r.x for r in rows.select(built.alias("x")).collect()] == [2.0, 0.0]
    assert set(parts) == {"multilevel_localization_f1_reward", "file_reward", "module_reward", "entity_reward"}


def turns(spark, *pairs):
    return spark.createDataFrame([(i, t, c, 0.5) for i, (t, c) in enumerate(pairs)], "i int, turns long, tool_calls long, localization double")


def test_turn_rewards(spark):
    rows = turns(spark, (0, 0), (1, 5), (2, 1), (5, 9), (6, 9), (20, 40))
    got = [r.x for r in rows.select(rewards.turn_efficiency().alias("x")).collect()]
    assert got == pytest.approx([0, 0, 0, 1, 0.9, 0])
    assert [r.x for r in rows.select(rewards.multiturn().alias("x")).collect()] == [0, 0, 1, 1, 1, 1]
    assert [r.x for r in rows.select(rewards.tool_use().alias("x")).collect()] == pytest.approx([0, 5, 0.5, 1.8, 1.5, 2])


def test_cosine_rewards(spark):
    rows = turns(spark, (0, 0), (10, 50), (11, 56))
    good = F.col("localization")
    assert [r.x for r in rows.select(rewards.cosine_turns(good).alias("x")).collect()] == pytest.approx([5.0 * 0.5 * 2, 2.5 * (cos(pi) + 1), -10])
    assert [r.x for r in rows.select(rewards.cosine_calls(good - 0.1).alias("x")).collect()] == pytest.approx([-5.0, -2.5 * (cos(pi) + 1), -10])
    unknown = rows.withColumn("localization", F.lit(None).cast("double"))
    total, parts = rewards.cosine(found="localization")
    # a localization that failed counts 0.0, and both parts take the branch of wrong answers
    low = [-5.0 * 0.5 * 2 * 2, -2.5 * (cos(pi) + 1) * 2, -20.0]
    assert [r.x for r in unknown.select(total.alias("x")).collect()] == pytest.approx(low)
    three = turns(spark, (3, 4)).withColumn("localization", F.lit(None).cast("double"))
    assert round(three.select(total.alias("x")).first().x, 2) == -8.14
    assert set(parts) == {"turn_cosine_reward", "tool_cosine_reward"}
    sets = turns(spark, (3, 4), (3, 4)).withColumns({c: F.when(F.col("i") == 0, F.array(F.lit("a"))) for c in ("files", "modules", "entities")})
    gold = F.array(F.struct(F.lit("a").alias("file"), F.struct(F.array(F.lit("a")).alias("edited_modules"), F.array(F.lit("a")).alias("edited_entities")).alias("changes")))
    rows = sets.withColumns({"file_changes": gold, "final_message": F.lit("x")})
    got = rewards.score(rows, [{"fn": "cosine_reward", "args": {"entity_level_weight": 0.5}}]).orderBy("i").collect()
    assert set(got[0].reward_dict) == {"turn_cosine_reward", "tool_cosine_reward", "multilevel_localization_f1_reward", "file_reward", "module_reward", "entity_reward"}
    assert got[0].reward_dict["multilevel_localization_f1_reward"] == 2.5 and got[0].total_reward == pytest.approx(8.14, abs=0.01)
    assert set(got[1].reward_dict) == {"turn_cosine_reward", "tool_cosine_reward"} and got[1].total_reward == pytest.approx(-8.14, abs=0.01)


def test_answers_that_fail_to_parse_score_nothing(spark):
    rows = spark.createDataFrame([(1, "a.py\nfunction: f"), (2, "a.py\nfunction:  \nfunction: f")], "traj_id long, answer string")
    target = F.array(F.struct(F.lit("a.py").alias("file"), F.lit(1).alias("old_start"), F.lit(1).alias("old_count")))
    sets = answer.answer_sets(rows).withColumns({"target": target, "file_changes": F.lit(None), "final_message": F.lit("x")})
    got = rewards.score(sets, [{"fn": "file_localization_f1_reward", "args": {"file_level_weight": 2.0}}]).orderBy("traj_id").collect()
    assert [r.total_reward for r in got] == [2.0, 0.0]
    assert [r.reward_dict for r in got] == [{"file_level_score": 1.0}, {"file_localization_f1_reward": 0.0}]


def test_manager_order_nulls_and_empty_message(spark):
    rows = turns(spark, (5, 9), (5, 9)).withColumn("final_message", F.when(F.col("i") == 0, "x").otherwise(""))
    rewards.reward("always_null")(lambda: F.lit(None).cast("double"))
    got = rewards.score(rows, [{"fn": "turn_efficiency"}, {"fn": "multiturn_reward", "args": {"minimal_turns": 5}}, {"fn": "always_null"}]).orderBy("i").collect()
    rewards.REGISTRY.pop("always_null")
    assert [r.total_reward for r in got] == [1.0, -10.0]
    assert got[1].reward_dict == {"turn_efficiency": 1.0, "multiturn_reward": 0.0, "always_null": 0.0}
    rewards.reward("null_with_parts")(lambda: (F.when(F.col("turns") > 5, 1.0), {"part": F.lit(2.0)}))
    got = rewards.score(turns(spark, (5, 1), (6, 1)).withColumn("final_message", F.lit("x")), [{"fn": "null_with_parts"}, {"fn": "no such"}, {"fn": "turn_efficiency", "args": {"wrong": 1}}]).orderBy("i").collect()
    rewards.REGISTRY.pop("null_with_parts")
    assert [r.total_reward for r in got] == [0.0, 1.0]
    assert [r.reward_dict for r in got] == [{"null_with_parts": 0.0, "no such": 0.0, "turn_efficiency": 0.0}, {"part": 2.0, "no such": 0.0, "turn_efficiency": 0.0}]
    with pytest.raises(ValueError, match="unknown reward"):
        rewards.get_reward("no such")


def test_experiments(tmp_path):
    assert rewards.load_experiment(None)["reward"] == rewards.DEFAULT_REWARDS
    tools.tool("own")(lambda: None)
    chosen = rewards.load_experiment({"reward": [{"fn": "multiturn_reward"}], "tools": ["own", "grep"]})
    tools.REGISTRY.pop("own")
    assert chosen["tools"] == ["own", "grep"] and chosen["prompts"] == {}
    with pytest.raises(ValueError, match="unknown tool"):
        rewards.load_experiment({"reward": [], "tools": ["own"]})
    with pytest.raises(ValueError, match="built-in"):
        tools.tool("terminal")
    pytest.importorskip("yaml")
    path = tmp_path / "e.yaml"
    path.write_text("reward:\n  - fn: multiturn_reward\n    args: {minimal_turns: 2}\ntools: [glob]\nprompts: {system_prompt: s}\n")
    assert rewards.read_experiment(str(path)) == {"reward": [{"fn": "multiturn_reward", "args": {"minimal_turns": 2}}], "tools": ["glob"], "prompts": {"system_prompt": "s"}}
    with pytest.raises(ValueError):
        rewards.load_experiment({"reward": [{"fn": "no such"}]})


def events(spark, rows):
    kind = "traj_id long, pos long, kind string, llm_response_id string, role string, prompt_token_ids array<int>, response_token_ids array<int>, tool_calls array<struct<id:string,function:struct<name:string,arguments:string>>>"
    return spark.createDataFrame(rows, kind)


def test_event_metrics(spark):
    call = lambda name: ("1", (name, "{}") if name else None)
    log = events(
        spark,
        [
            (1, 1, "TokenEvent", None, None, [1] * 4, [1] * 3, None),
            (1, 2, "ActionEvent", "b", None, None, None, None),
            (1, 3, "ActionEvent", "a", None, None, None, None),
            (1, 4, "ActionEvent", "b", None, None, None, None),
            (1, 5, "ActionEvent", "", None, None, None, None),
            (1, 6, "TokenEvent", None, "assistant", [1] * 6, [1] * 2, [call("x"), call("y"), call("x"), call(None)]),
            (2, 1, None, None, "user", None, None, None),
        ],
    )
    got = {r.traj_id: r for r in metrics.token_totals(log).collect()}
    assert tuple(got[1])[1:] == (15, 10, 5, 5.0, 2.5) and tuple(got[2])[1:] == (0, 0, 0, 0.0, 0.0)
    path = {r.traj_id: r for r in metrics.trajectory(log).collect()}
    assert path[1].tool_calls == 4 and path[1].tool_calls_by_turn == [2, 1] and path[1].tool_calls_per_turn == 2.0
    assert path[2].tool_calls_by_turn == [] and path[2].tool_calls_per_turn == 0.0
    calls = {r.traj_id: r for r in metrics.tool_calls(log).collect()}
    assert calls[1].tool_call_breakdown == {"unknown": 1, "x": 2, "y": 1} and calls[1].avg_tool_calls_per_step == 2.0
    assert calls[2].tool_call_breakdown == {}
    assert {(r.traj_id, r.kind): r.n for r in metrics.kind_histogram(log).collect()}[2, "Unknown"] == 1
    flat = {r.traj_id: r for r in metrics.efficiency(log).collect()}
    assert flat[1].tokens == 15 and flat[1].steps == 2
    assert metrics.token_totals(log.limit(0)).collect() == []
    row = spark.createDataFrame([({"a": 1.0, "b": None},), (None,), ({},)], "m map<string,double>")
    assert [r.x for r in row.select(metrics.map_total(F.col("m")).alias("x")).collect()] == [1.0, 0.0, 0.0]


def test_rollout_rows(spark):
    log = events(spark, [(1, 1, "TokenEvent", None, None, [1, 2], [3], None), (1, 2, "ActionEvent", None, None, None, None, None), (1, 3, "TokenEvent", None, None, [1, 2, 3, 9, 9], [4, 5], None)])
    got = rollout.rollout_steps(log, spark.createDataFrame([(1, 0.5), (2, 0.25)], "traj_id long, reward double")).orderBy("traj_id", "step_id").collect()
    assert [(r.traj_id, r.step_id, r.is_last_step, r.stop_reason) for r in got] == [(1, 0, False, "complete"), (1, 1, True, "complete"), (2, 0, True, "error")]
    assert got[2].response_ids == [rollout.SENTINEL] and got[2].loss_mask == [1] and got[2].reward == 0.25
    assert rollout.turn_masks(log).first().loss_mask == [1, 0, 0, 1, 1]


def test_all_or_none(spark):
    rows = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert rollout.all_or_none(rows, "b").first().ok
    with pytest.raises(Exception, match="some rows only"):
        rollout.all_or_none(rows, "a").collect()


def test_batch_and_group_means(spark):
    a = spark.createDataFrame([(1, 1.0, True, "x"), (2, None, False, "y")], "traj_id long, r double, ok boolean, s string")
    row = rollout.batch_means(a, a.select("traj_id", "ok")).first().asDict()
    assert row == {"reward/r": 1.0, "reward/ok": 0.5, "metrics/ok": 0.5}
    long = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (0, "b", 1.0), (1, "c", 1.0)], "group_id int, key string, value double")
    assert [tuple(r) for r in rollout.group_means(long, 0).collect()] == [("a", 2.0)]
