"""Named queries over the tables, one per operator, and the same results in SQL from the tables' columns alone.

The SQL never parses the texts that the fixtures write: it is written against the columns they were written from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import sources
from ..functions import answer as an
from ..functions import diff, text
from ..operators import metrics, order, prep, rewards, rollout, scoring
from . import report as rp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


#: The fixtures as SQL.
EV = """ev AS (
  SELECT user_id AS traj, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS pos, ts, value,
         CASE WHEN event_type IN ('view','click') THEN 'TokenEvent' WHEN event_type IN ('purchase','error') THEN 'ActionEvent' ELSE 'MessageEvent' END AS kind,
         event_id % 97 AS np, event_id % 31 AS nr,
         sum(CASE WHEN event_type IN ('view','click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS rid
  FROM events)"""
TC = f"""{EV}, tc AS (
  SELECT traj, count(*) FILTER (kind = 'TokenEvent') AS turns, count(*) FILTER (kind = 'ActionEvent') AS calls FROM ev GROUP BY traj)"""
IT = """it AS (
  SELECT l_orderkey AS k, l_partkey AS p, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS pr, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS g
  FROM lineitem GROUP BY 1, 2), sz AS (
  SELECT k, sum(pr * g)::DOUBLE AS c, sum(pr)::DOUBLE AS np, sum(g)::DOUBLE AS ng FROM it GROUP BY k), f AS (
  SELECT *, CASE WHEN np = 0 THEN 0.0::DOUBLE ELSE c / np END AS pre, CASE WHEN ng = 0 THEN 0.0::DOUBLE ELSE c / ng END AS rec FROM sz), s AS (
  SELECT *, CASE WHEN pre + rec = 0 THEN 0.0::DOUBLE ELSE 2 * pre * rec / (pre + rec) END AS f1 FROM f)"""
CH = """ch AS (
  SELECT conv_id AS traj, turn AS pos, role, CASE WHEN role = 'assistant' THEN (conv_id * 7 + turn * 3) % 4 ELSE 0 END AS n FROM conversations)"""
PQ = "pq AS (SELECT l_orderkey AS o, l_partkey AS p, CAST(floor(min(l_quantity)) AS INTEGER) AS q FROM lineitem GROUP BY 1, 2)"
RP = "rp AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS form, 'src/w' || conv_id || '.py' AS word FROM conversations)"


# --- event metrics ---------------------------------------------------------------------------------------------------
@query(
    "a1_token_totals",
    f"""WITH {EV}, a AS (SELECT traj, sum(CASE WHEN kind = 'TokenEvent' THEN np ELSE 0 END) AS p, sum(CASE WHEN kind = 'TokenEvent' THEN nr ELSE 0 END) AS r,
    count(*) FILTER (kind = 'TokenEvent') AS n FROM ev GROUP BY traj)
    SELECT traj AS traj_id, (p + r)::BIGINT AS total_tokens, p::BIGINT AS prompt_tokens, r::BIGINT AS response_tokens,
    round(CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE p::DOUBLE / n END, 6) AS avg_prompt_tokens, round(CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE r::DOUBLE / n END, 6) AS avg_response_tokens FROM a""",
)
def _(spark, sf):
    return metrics.token_totals(fx.events(spark, sf)).withColumns({c: r6(c) for c in ("avg_prompt_tokens", "avg_response_tokens")})


@query("a2_step_count", f"WITH {EV} SELECT traj AS traj_id, count(*) FILTER (kind = 'TokenEvent') AS steps FROM ev GROUP BY traj")
def _(spark, sf):
    return metrics.steps(fx.events(spark, sf))


@query(
    "a3_tool_call_names",
    f"""WITH {CH}, c AS (SELECT traj, 'tool' || ((traj + i) % 3) AS name FROM (SELECT traj, unnest(range(1, n + 1)) AS i FROM ch WHERE n > 0))
    SELECT traj AS traj_id, name, count(*) AS n FROM c GROUP BY 1, 2""",
)
def _(spark, sf):
    return metrics.tool_call_names(fx.chat(spark, sf))


@query(
    "a3_tool_calls",
    f"""WITH {CH} SELECT traj AS traj_id, sum(n)::BIGINT AS total_tool_calls,
    round(CASE WHEN count(*) FILTER (role = 'assistant') = 0 THEN 0.0::DOUBLE ELSE sum(n)::DOUBLE / count(*) FILTER (role = 'assistant') END, 6) AS avg_tool_calls_per_step,
    coalesce((SELECT string_agg(name || '=' || n, ',' ORDER BY name) FROM (SELECT 'tool' || ((c.traj + i.i) % 3) AS name, count(*) AS n FROM ch c, (SELECT unnest(range(1, 4)) AS i) i
    WHERE c.traj = ch.traj AND i.i <= c.n GROUP BY 1)), '') AS tool_call_breakdown FROM ch GROUP BY traj""",
)
def _(spark, sf):
    rows = metrics.tool_calls(fx.chat(spark, sf))
    return rows.select("traj_id", "total_tool_calls", r6("avg_tool_calls_per_step").alias("avg_tool_calls_per_step"), F.array_join(F.transform(F.map_entries("tool_call_breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("tool_call_breakdown"))


@query(
    "a4_efficiency",
    f"""WITH {CH}, a AS (SELECT traj, sum(CASE WHEN role = 'assistant' THEN pos % 5 ELSE 0 END) AS p, sum(CASE WHEN role = 'assistant' THEN pos % 3 ELSE 0 END) AS r,
    count(*) FILTER (role = 'assistant') AS s, sum(n) AS c FROM ch GROUP BY traj)
    SELECT traj AS traj_id, (p + r)::BIGINT AS tokens, s AS steps, round(CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE c::DOUBLE / s END, 6) AS avg_tool_calls_per_step,
    0.0::DOUBLE AS wall_clock_duration, p::BIGINT AS prompt_tokens, r::BIGINT AS response_tokens,
    round(CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE p::DOUBLE / s END, 6) AS avg_prompt_tokens, round(CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE r::DOUBLE / s END, 6) AS avg_response_tokens FROM a""",
)
def _(spark, sf):
    return metrics.efficiency(fx.chat(spark, sf)).withColumns({c: r6(c) for c in ("avg_tool_calls_per_step", "avg_prompt_tokens", "avg_response_tokens")})


@query(
    "a5_trajectory",
    f"""WITH {TC}, b AS (SELECT traj, rid, min(pos) AS mp, count(*) AS n FROM ev WHERE kind = 'ActionEvent' AND rid > 0 GROUP BY 1, 2),
    l AS (SELECT traj, string_agg(n::VARCHAR, ',' ORDER BY mp) AS by_turn FROM b GROUP BY traj)
    SELECT tc.traj AS traj_id, turns, calls AS tool_calls, round(CASE WHEN turns = 0 THEN 0.0::DOUBLE ELSE calls::DOUBLE / turns END, 6) AS tool_calls_per_turn,
    coalesce(by_turn, '') AS tool_calls_by_turn FROM tc LEFT JOIN l ON tc.traj = l.traj""",
)
def _(spark, sf):
    rows = metrics.trajectory(fx.events(spark, sf))
    return rows.withColumns({"tool_calls_per_turn": r6("tool_calls_per_turn"), "tool_calls_by_turn": F.array_join(F.col("tool_calls_by_turn").cast("array<string>"), ",")})


@query("a6_kind_histogram", f"WITH {EV} SELECT traj AS traj_id, kind, count(*) AS n FROM ev GROUP BY 1, 2")
def _(spark, sf):
    return metrics.kind_histogram(fx.events(spark, sf))


@query(
    "a7_kind_pivot",
    f"""WITH {EV} SELECT traj AS traj_id, count(*) FILTER (kind = 'ActionEvent') AS "count_ActionEvent", count(*) FILTER (kind = 'MessageEvent') AS "count_MessageEvent",
    count(*) FILTER (kind = 'TokenEvent') AS "count_TokenEvent" FROM ev GROUP BY traj""",
)
def _(spark, sf):
    return metrics.kind_pivot(fx.events(spark, sf))


MX = """mx AS (SELECT user_id AS traj, event_id, CASE WHEN event_id % 11 = 0 THEN 'Unknown' ELSE CASE event_type WHEN 'view' THEN 'TokenEvent' WHEN 'click' THEN 'ObservationEvent'
    WHEN 'purchase' THEN 'ActionEvent' WHEN 'error' THEN 'SystemPromptEvent' ELSE 'MessageEvent' END END AS kind FROM events)"""
MX_KINDS = ["ActionEvent", "MessageEvent", "ObservationEvent", "SystemPromptEvent", "TokenEvent", "Unknown"]
MX_COUNTS = ", ".join(f"count(*) FILTER (kind = '{k}') AS \"count_{k}\"" for k in MX_KINDS)


@query("a7_found_kinds", f"WITH {MX} SELECT traj AS traj_id, {MX_COUNTS} FROM mx GROUP BY traj")
def _(spark, sf):
    return metrics.kind_pivot(fx.mixed_events(spark, sf))


@query("f1_token_events", f"WITH {EV} SELECT traj AS traj_id, pos, np AS n_prompt FROM ev WHERE kind = 'TokenEvent'")
def _(spark, sf):
    return fx.events(spark, sf).where(metrics.is_kind("TokenEvent")).select("traj_id", "pos", F.size("prompt_token_ids").cast("long").alias("n_prompt"))


@query("f2_action_events", f"WITH {EV} SELECT traj AS traj_id, pos FROM ev WHERE kind = 'ActionEvent'")
def _(spark, sf):
    return fx.events(spark, sf).where(metrics.is_kind("ActionEvent")).select("traj_id", "pos")


@query("f3_assistant_with_calls", f"WITH {CH} SELECT traj AS traj_id, pos, n AS n_calls FROM ch WHERE n > 0")
def _(spark, sf):
    return fx.chat(spark, sf).where((F.col("role") == "assistant") & F.col("tool_calls").isNotNull()).select("traj_id", "pos", F.size("tool_calls").cast("long").alias("n_calls"))


@query("f4_with_response_id", f"WITH {EV} SELECT traj AS traj_id, pos, rid::BIGINT::VARCHAR AS llm_response_id FROM ev WHERE rid > 0")
def _(spark, sf):
    return fx.events(spark, sf).where(F.coalesce("llm_response_id", F.lit("")) != "").select("traj_id", "pos", "llm_response_id")


@query(
    "f5_completed",
    f"""WITH {RP}, l AS (SELECT conv_id, max(turn) AS t, count(*) AS n FROM rp GROUP BY 1)
    SELECT l.conv_id, ((c.role = 'assistant' AND rp.form IN (0, 1, 2)) OR l.n >= 7) AS completed
    FROM l JOIN rp ON rp.conv_id = l.conv_id AND rp.turn = l.t JOIN conversations c ON c.conv_id = l.conv_id AND c.turn = l.t""",
)
def _(spark, sf):
    said = fx.replies(spark, sf).join(fx.table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    chat = said.select(F.col("conv_id").alias("traj_id"), F.col("turn").alias("pos"), "role", F.col("reply").alias("content"))
    return metrics.completed(chat, 7).withColumnRenamed("traj_id", "conv_id")


@query("a14_has_tool_turn", f"WITH {CH} SELECT traj AS traj_id, max(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS has_tool_turn FROM ch GROUP BY traj")
def _(spark, sf):
    return metrics.has_tool_turn(fx.chat(spark, sf))


@query("a15_tool_turn_mean", f"WITH {CH} SELECT traj AS traj_id, round(least(5.0::DOUBLE, coalesce(avg(CASE WHEN n > 0 THEN n::DOUBLE END), 0.0::DOUBLE)) / 5.0::DOUBLE, 6) AS tool_turn_mean FROM ch GROUP BY traj")
def _(spark, sf):
    return metrics.mean_calls_of_tool_turns(fx.chat(spark, sf)).withColumn("tool_turn_mean", r6("tool_turn_mean"))


@query(
    "a16_rubric",
    f"""WITH {CH}, a AS (SELECT traj, max(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS h, least(5.0::DOUBLE, coalesce(avg(CASE WHEN n > 0 THEN n::DOUBLE END), 0.0::DOUBLE)) / 5.0::DOUBLE AS m FROM ch GROUP BY traj)
    SELECT traj AS traj_id, round(h + m, 6) AS score FROM a""",
)
def _(spark, sf):
    return metrics.rubric(fx.chat(spark, sf)).withColumn("score", r6("score"))


@query("a17_calls_per_turn", f"WITH {TC} SELECT traj AS traj_id, round(CASE WHEN turns = 0 THEN 0.0::DOUBLE ELSE calls::DOUBLE / turns END, 6) AS tool_use_reward FROM tc")
def _(spark, sf):
    return metrics.turns_and_calls(fx.events(spark, sf)).select("traj_id", r6(rewards.tool_use()).alias("tool_use_reward"))


@query("u5_observed_kinds", f"WITH {EV} SELECT DISTINCT kind FROM ev")
def _(spark, sf):
    return metrics.observed_kinds(fx.events(spark, sf))


# --- set scores --------------------------------------------------------------------------------------------------------
def _sizes(spark, sf):
    rows = fx.item_rows(spark, sf)
    return scoring.long_sizes(rows, "key", order.parts_of(rows))


@query("a8_set_f1_strict_long", f"WITH {IT} SELECT k AS key, round(f1, 6) AS f1 FROM s")
def _(spark, sf):
    return _sizes(spark, sf).select("key", r6(scoring.f1(F.col("n_common"), F.col("n_predicted"), F.col("n_gold"))).alias("f1"))


@query("a8_set_f1_strict_array", f"WITH {IT} SELECT k AS key, round(f1, 6) AS f1 FROM s")
def _(spark, sf):
    return fx.item_sets(spark, sf).select("key", r6(scoring.set_f1(F.col("predicted"), F.col("gold"))).alias("f1"))


@query("a9_set_f1_lenient", f"WITH {IT} SELECT k AS key, round(CASE WHEN np = 0 AND ng = 0 THEN 1.0::DOUBLE ELSE f1 END, 6) AS f1 FROM s")
def _(spark, sf):
    untidy = F.transform("predicted", lambda p: F.concat(F.lit(" ./"), p, F.lit("\t")))
    return fx.item_sets(spark, sf).select("key", r6(scoring.set_f1(F.transform(untidy, text.normalize_path), F.col("gold"), 1.0)).alias("f1"))


@query("a11_multilevel_f1", f"WITH {IT} SELECT k AS key, round(f1, 6) AS file_reward, round(2.0::DOUBLE * f1 + f1 + 0.5::DOUBLE * f1, 6) AS total FROM s")
def _(spark, sf):
    change = lambda p: F.struct(p.alias("file"), F.struct(F.array(p).alias("edited_modules"), F.array(p).alias("edited_entities")).alias("changes"))
    rows = fx.item_sets(spark, sf).withColumn("file_changes", F.transform("gold", change))
    predicted = {level: F.col("predicted") for level in scoring.LEVELS}
    total, parts = scoring.multilevel(predicted, scoring.gold_levels(F.col("file_changes")), {"file": 2.0, "module": 1.0, "entity": 0.5})
    return rows.select("key", r6(parts["file_reward"]).alias("file_reward"), r6(total).alias("total"))


@query(
    "a11_levels_apart",
    """WITH it AS (SELECT l_orderkey AS k, l_partkey AS p, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS pr, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS g FROM lineitem GROUP BY 1, 2), sz AS (
    SELECT k, m, sum(CASE WHEN p % 3 <> m THEN pr * g ELSE 0 END)::DOUBLE AS c, sum(pr)::DOUBLE AS np, sum(CASE WHEN p % 3 <> m THEN g ELSE 0 END)::DOUBLE AS ng FROM it, (SELECT unnest([0, 1, 2]) AS m) GROUP BY k, m), f AS (
    SELECT k, m, CASE WHEN c = 0 THEN 0.0::DOUBLE ELSE 2 * (c / np) * (c / ng) / (c / np + c / ng) END AS f1 FROM sz)
    SELECT k AS key, round(max(f1) FILTER (m = 0), 6) AS file_reward, round(max(f1) FILTER (m = 1), 6) AS module_reward, round(max(f1) FILTER (m = 2), 6) AS entity_reward,
    round(2.0::DOUBLE * max(f1) FILTER (m = 0) + max(f1) FILTER (m = 1) + 0.5::DOUBLE * max(f1) FILTER (m = 2), 6) AS total FROM f GROUP BY k""",
)
def _(spark, sf):
    sets = fx.items(spark, sf, ("key",)).groupBy("key")
    item = F.col("item").cast("string")
    gold = lambda m: F.collect_set(F.when(F.col("gold") & (F.col("item") % 3 != m), item))
    rows = sets.agg(F.collect_set(F.when(F.col("predicted"), item)).alias("predicted"), gold(0).alias("f"), gold(1).alias("m"), gold(2).alias("e"))
    none = F.array().cast("array<string>")
    change = lambda file, modules, entities: F.struct(file.alias("file"), F.struct(modules.alias("edited_modules"), entities.alias("edited_entities")).alias("changes"))
    # files in entries of their own; what an entry without a file says of modules and entities counts as well
    changes = F.concat(F.transform("f", lambda p: change(p, none, none)), F.array(change(F.lit(None).cast("string"), F.col("m"), F.col("e"))))
    total, parts = scoring.multilevel({level: F.col("predicted") for level in scoring.LEVELS}, scoring.gold_levels(changes), {"file": 2.0, "module": 1.0, "entity": 0.5})
    return rows.select("key", *[r6(parts[f"{level}_reward"]).alias(f"{level}_reward") for level in scoring.LEVELS], r6(total).alias("total"))


@query("a12_file_f1", f"WITH {IT} SELECT k AS key, round(3.0::DOUBLE * f1, 6) AS score, round(f1, 6) AS part FROM s")
def _(spark, sf):
    rows = fx.item_sets(spark, sf).withColumn("target", F.transform("gold", lambda p: F.struct(p.alias("file"), F.lit(1).alias("old_start"), F.lit(1).alias("old_count"))))
    score, parts = scoring.file_score(F.col("predicted"), F.col("target"), 3.0)
    return rows.select("key", r6(score).alias("score"), r6(parts["file_level_score"]).alias("part"))


@query("a13_precision_recall", f"WITH {IT} SELECT k AS key, round(pre, 6) AS precision, round(rec, 6) AS recall FROM s")
def _(spark, sf):
    rows = _sizes(spark, sf)
    return rows.select("key", r6(scoring.precision(F.col("n_common"), F.col("n_predicted"))).alias("precision"), r6(scoring.recall(F.col("n_common"), F.col("n_gold"))).alias("recall"))


@query(
    "a13_result_tool",
    f"""WITH {IT} SELECT k AS key, CASE WHEN k % 7 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS success, CASE WHEN k % 7 = 0 THEN 0.0::DOUBLE ELSE round(pre, 6) END AS precision,
    CASE WHEN k % 7 = 0 THEN 0.0::DOUBLE ELSE round(rec, 6) END AS recall, CASE WHEN k % 7 = 0 THEN 0.0::DOUBLE ELSE round(f1, 6) END AS f1 FROM s""",
)
def _(spark, sf):
    rows = fx.item_sets(spark, sf).withColumn("predicted", F.when(F.col("key") % 7 != 0, F.col("predicted")))
    return rows.select("key", *[r6(c).alias(n) for n, c in scoring.tool_result(F.col("predicted"), F.col("gold")).items()])


@query("j1_set_intersection", f"WITH {IT} SELECT k AS key, c::BIGINT AS n_common FROM s WHERE c > 0")
def _(spark, sf):
    rows = fx.items(spark, sf)
    both = rows.where("predicted").select("key", "item").join(rows.where("gold").select("key", "item"), ["key", "item"])
    return both.repartition(order.parts_of(fx.item_rows(spark, sf)), "key").groupBy("key").agg(F.count("*").alias("n_common"))


@query("u3_intersection", f"WITH {IT} SELECT k AS key, coalesce(string_agg('src/m' || p || '.py', ',' ORDER BY 'src/m' || p || '.py') FILTER (pr = 1 AND g = 1), '') AS common FROM it GROUP BY k")
def _(spark, sf):
    return fx.item_sets(spark, sf).select("key", F.array_join(F.array_sort(F.array_intersect("predicted", "gold")), ",").alias("common"))


@query("u4_distinct", "SELECT DISTINCT l_orderkey AS key, l_partkey AS item FROM lineitem")
def _(spark, sf):
    return fx.items(spark, sf).select("key", "item")


# --- rewards -----------------------------------------------------------------------------------------------------------
B2 = "CASE WHEN turns <= 1 OR calls <= 1 THEN 0.0::DOUBLE WHEN turns <= 5 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * (turns - 5)) END"
HI = "CASE WHEN traj % 2 = 0 THEN 5.0::DOUBLE ELSE -5.0::DOUBLE END"
B4 = f"CASE WHEN turns > 10 THEN -10.0::DOUBLE ELSE 0.5::DOUBLE * ({HI}) * (cos(pi() * turns / 10.0::DOUBLE) + 1.0::DOUBLE) END"
B5 = f"CASE WHEN calls::DOUBLE / greatest(1, turns) > 5 THEN -10.0::DOUBLE ELSE 0.5::DOUBLE * ({HI}) * (cos(pi() * (calls::DOUBLE / greatest(1, turns)) / 5.0::DOUBLE) + 1.0::DOUBLE) END"
#: Short trajectories, so that turns differ: fourteen events of a log each.
TC14 = """tc AS (SELECT event_id // 14 AS traj, count(CASE WHEN event_type IN ('view','click') THEN 1 END) AS turns, count(CASE WHEN event_type IN ('purchase','error') THEN 1 END) AS calls FROM events GROUP BY 1)"""


def _short(spark, sf):
    token = F.col("event_type").isin("view", "click")
    kind = F.when(token, "TokenEvent").when(F.col("event_type").isin("purchase", "error"), "ActionEvent").otherwise("MessageEvent")
    rows = metrics.turns_and_calls(fx.table(spark, sf, "events").select(F.floor(F.col("event_id") / 14).alias("traj_id"), kind.alias("kind")))
    return rows.withColumn("localization", F.when(F.col("traj_id") % 2 == 0, 0.75).otherwise(0.25))


@query("b1_multiturn", f"WITH {TC14} SELECT traj AS traj_id, CASE WHEN turns > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM tc")
def _(spark, sf):
    return _short(spark, sf).select("traj_id", rewards.multiturn().alias("score"))


@query("b2_turn_efficiency", f"WITH {TC14} SELECT traj AS traj_id, round({B2}, 6) AS score FROM tc")
def _(spark, sf):
    return _short(spark, sf).select("traj_id", r6(rewards.turn_efficiency()).alias("score"))


@query("b3_half_cosine", "SELECT o_orderkey, round(1.0::DOUBLE + 0.5::DOUBLE * 3.0::DOUBLE * (cos(pi() * (o_orderkey % 11) / 10.0::DOUBLE) + 1.0::DOUBLE), 6) AS score FROM orders")
def _(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", r6(rewards.half_cosine(F.col("o_orderkey") % 11, 10.0, 1.0, 4.0)).alias("score"))


@query("b4_cosine_turns", f"WITH {TC14} SELECT traj AS traj_id, round({B4}, 6) + 0.0::DOUBLE AS score FROM tc")
def _(spark, sf):
    return _short(spark, sf).select("traj_id", r6(rewards.cosine_turns(F.col("localization"))).alias("score"))


@query("b5_cosine_calls", f"WITH {TC14} SELECT traj AS traj_id, round({B5}, 6) + 0.0::DOUBLE AS score FROM tc")
def _(spark, sf):
    return _short(spark, sf).select("traj_id", r6(rewards.cosine_calls(F.col("localization"))).alias("score"))


@query("b6_cosine", f"WITH {TC14} SELECT traj AS traj_id, round({B4} + {B5}, 6) + 0.0::DOUBLE AS score FROM tc")
def _(spark, sf):
    return _short(spark, sf).select("traj_id", r6(rewards.cosine(found="localization")[0]).alias("score"))


@query(
    "b7_reward_manager",
    f"""WITH {TC14} SELECT traj AS traj_id, round(CASE WHEN traj % 5 = 0 THEN -10.0::DOUBLE ELSE {B4} + {B5} + {B2} + CASE WHEN turns > 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END, 6) + 0.0::DOUBLE AS total_reward,
    round({B2}, 6) AS turn_efficiency, round({B4}, 6) + 0.0::DOUBLE AS turn_cosine_reward FROM tc""",
)
def _(spark, sf):
    rows = _short(spark, sf).withColumn("final_message", F.when(F.col("traj_id") % 5 == 0, "").otherwise("done"))
    done = rewards.score(rows, [{"fn": "cosine_reward", "args": {"found": "localization"}}, {"fn": "turn_efficiency"}, {"fn": "multiturn_reward", "args": {"minimal_turns": 2}}])
    part = lambda n: r6(F.col("reward_dict")[n]).alias(n)
    return done.select("traj_id", r6("total_reward").alias("total_reward"), part("turn_efficiency"), part("turn_cosine_reward"))


#: Answers of three forms by trajectory: found (F1 1 at all levels), not parsed (no localization at all), and wrong (F1 0).
FOUND = "CASE WHEN traj % 3 = 0 THEN 5.0::DOUBLE ELSE -5.0::DOUBLE END"


@query(
    "b6_failed_localization",
    f"""WITH {TC14}, r AS (SELECT traj, {B4.replace(HI, FOUND)} AS t, {B5.replace(HI, FOUND)} AS c FROM tc)
    SELECT traj AS traj_id, round(t + c, 6) + 0.0::DOUBLE AS total_reward, round(t, 6) + 0.0::DOUBLE AS turn_cosine_reward, round(c, 6) + 0.0::DOUBLE AS tool_cosine_reward,
    CASE WHEN traj % 3 = 1 THEN NULL WHEN traj % 3 = 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS multilevel, CASE WHEN traj % 3 = 1 THEN 2 ELSE 6 END AS n_parts FROM r""",
)
def _(spark, sf):
    form = F.col("traj_id") % 3
    lines = F.when(form == 0, "a.py\nclass: C\nfunction: f").when(form == 1, "a.py\nfunction:\nfunction: f").otherwise("b.py\nfunction: f")
    gold = F.array(F.struct(F.lit("a.py").alias("file"), F.struct(F.array(F.lit("a.py:C")).alias("edited_modules"), F.array(F.lit("a.py:C.f")).alias("edited_entities")).alias("changes")))
    rows = _short(spark, sf)
    sets = an.answer_sets(rows.select("traj_id", lines.alias("answer")))
    done = rewards.score(rows.join(sets, "traj_id").withColumn("file_changes", gold).withColumn("final_message", F.lit("x")), [{"fn": "cosine_reward"}])
    part = lambda n: r6(F.col("reward_dict")[n]).alias(n)
    shown = [r6("total_reward").alias("total_reward"), part("turn_cosine_reward"), part("tool_cosine_reward"), F.col("reward_dict")["multilevel_localization_f1_reward"].alias("multilevel")]
    return done.select("traj_id", *shown, F.size("reward_dict").alias("n_parts"))


@query("a22_map_total", "SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 THEN 0.0::DOUBLE ELSE (o_orderkey % 7)::DOUBLE + 0.5::DOUBLE END, 6) AS total FROM orders")
def _(spark, sf):
    parts = F.create_map(F.lit("a"), (F.col("o_orderkey") % 7).cast("double"), F.lit("b"), F.lit(0.5))
    return fx.table(spark, sf, "orders").select("o_orderkey", r6(metrics.map_total(F.when(F.col("o_orderkey") % 3 != 0, parts))).alias("total"))


@query("u6_map_merge", "SELECT o_orderkey, (o_orderkey % 5) AS a, (o_orderkey % 3) AS b, 3 AS n_keys FROM orders")
def _(spark, sf):
    left = F.create_map(F.lit("a"), F.col("o_orderkey"), F.lit("b"), F.col("o_orderkey") % 3)
    right = F.create_map(F.lit("a"), F.col("o_orderkey") % 5, F.lit("c"), F.lit(1).cast("long"))
    kept = F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)
    return fx.table(spark, sf, "orders").select("o_orderkey", kept["a"].alias("a"), kept["b"].alias("b"), F.size(kept).alias("n_keys"))


# --- rollouts ----------------------------------------------------------------------------------------------------------
def _trajectories(spark, sf):
    users = fx.table(spark, sf, "events").select(F.col("user_id").alias("traj_id")).distinct()
    return users.select(F.explode(F.array(F.col("traj_id"), -F.col("traj_id") - 1)).alias("traj_id")).withColumn("reward", (F.col("traj_id") % 7).cast("double"))


STEPS = f"""{EV}, tr AS (SELECT DISTINCT user_id AS t FROM events), ids AS (SELECT t FROM tr UNION ALL SELECT -t - 1 FROM tr),
    st AS (SELECT traj, pos, np, nr, row_number() OVER (PARTITION BY traj ORDER BY pos) AS rn, count(*) OVER (PARTITION BY traj) AS n FROM ev WHERE kind = 'TokenEvent')"""


@query(
    "p8_p9_rollout_steps",
    f"""WITH {STEPS} SELECT ids.t AS traj_id, coalesce(rn - 1, 0)::BIGINT AS step_id, coalesce(np, 1)::BIGINT AS n_prompt, coalesce(nr, 1)::BIGINT AS n_response,
    (ids.t % 7)::DOUBLE AS reward, CASE WHEN rn IS NULL THEN 'error' ELSE 'complete' END AS stop_reason, coalesce(nr, 1)::BIGINT AS n_mask, coalesce(rn = n, true) AS is_last_step
    FROM ids LEFT JOIN st ON st.traj = ids.t""",
)
def _(spark, sf):
    rows = rollout.rollout_steps(fx.events(spark, sf), _trajectories(spark, sf))
    n = lambda c: F.size(c).cast("long")
    return rows.select("traj_id", "step_id", n("prompt_token_ids").alias("n_prompt"), n("response_ids").alias("n_response"), "reward", "stop_reason", F.aggregate("loss_mask", F.lit(0), lambda a, b: a + b).cast("long").alias("n_mask"), "is_last_step")


@query("w3_last_steps", f"WITH {STEPS} SELECT ids.t AS traj_id, greatest(1, count(st.pos)) AS n_steps, 1::BIGINT AS n_last FROM ids LEFT JOIN st ON st.traj = ids.t GROUP BY ids.t")
def _(spark, sf):
    rows = rollout.rollout_steps(fx.events(spark, sf), _trajectories(spark, sf))
    return rows.groupBy("traj_id").agg(F.count("*").alias("n_steps"), F.count_if("is_last_step").alias("n_last"))


@query("w4_step_ordinal", f"WITH {STEPS} SELECT traj AS traj_id, pos, (rn - 1)::BIGINT AS step_id FROM st")
def _(spark, sf):
    own = fx.events(spark, sf).where(metrics.is_kind("TokenEvent"))
    return own.select("traj_id", "pos", (F.row_number().over(Window.partitionBy("traj_id").orderBy("pos")) - 1).cast("long").alias("step_id"))


@query(
    "w5_turn_masks",
    f"""WITH {EV}, s AS (SELECT traj, pos, np, nr, lag(np + nr) OVER (PARTITION BY traj ORDER BY pos) AS b FROM ev WHERE kind = 'TokenEvent')
    SELECT traj AS traj_id, string_agg(repeat('0', CASE WHEN b IS NULL THEN 0 ELSE greatest(0, np - b) END::BIGINT) || repeat('1', nr::BIGINT), '' ORDER BY pos) AS loss_mask FROM s GROUP BY traj""",
)
def _(spark, sf):
    return rollout.turn_masks(fx.events(spark, sf)).select("traj_id", F.array_join(F.col("loss_mask").cast("array<string>"), "").alias("loss_mask"))


@query(
    "a18_batch_means",
    f"""WITH {TC14} SELECT round(avg({B2}), 6) AS "reward/turn_efficiency", round(avg(turns::DOUBLE), 6) AS "metrics/turns", round(avg(calls::DOUBLE), 6) AS "metrics/tool_calls" FROM tc""",
)
def _(spark, sf):
    rows = _short(spark, sf)
    means = rollout.batch_means(rows.select("traj_id", rewards.turn_efficiency().alias("turn_efficiency")), rows.select("traj_id", "turns", "tool_calls", F.lit("x").alias("name")))
    return means.select(*[r6(F.col(f"`{c}`")).alias(c) for c in means.columns])


@query(
    "f8_numeric_columns",
    """WITH d AS (SELECT *, n_chars > 100 AS is_long FROM documents), c AS (SELECT column_name AS name FROM (DESCRIBE SELECT * FROM d) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'BOOLEAN'))
    SELECT name, round(CASE name WHEN 'doc_id' THEN (SELECT avg(doc_id::DOUBLE) FROM d) WHEN 'n_chars' THEN (SELECT avg(n_chars::DOUBLE) FROM d) WHEN 'is_long' THEN (SELECT avg(is_long::INTEGER::DOUBLE) FROM d) END, 4) AS mean FROM c""",
)
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumn("is_long", F.col("n_chars") > 100)
    names = rollout.numeric_columns(docs)
    means = docs.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names])
    return means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.round(c, 4).alias("mean")) for c in names])).alias("m")).select("m.*")


@query(
    "a19_group_means",
    """WITH a AS (SELECT o_custkey % 10 AS g, 'price' AS k, avg(o_totalprice) AS v FROM orders GROUP BY 1 UNION ALL
    SELECT o_custkey % 10, 'count', count(*)::DOUBLE FROM orders GROUP BY 1)
    SELECT k AS key, round(avg(v), 4) AS mean FROM a GROUP BY k""",
)
def _(spark, sf):
    g = fx.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 10).alias("group_id")).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("count"))
    some = F.when(F.col("group_id") != 3, F.lit(1.0))  # a key that one group lacks
    long = g.select("group_id", F.explode(F.create_map(F.lit("price"), "price", F.lit("count"), "count", F.lit("partial"), some)).alias("key", "value"))
    return rollout.group_means(long, 0).select("key", F.round("mean", 4).alias("mean"))


@query(
    "a20_staleness",
    """SELECT o_custkey AS group_id, round(avg((50 - o_orderkey % 50)::DOUBLE), 6) AS mean, max(50 - o_orderkey % 50) AS max, min(50 - o_orderkey % 50) AS min,
    round((count(*) FILTER (50 - o_orderkey % 50 > 0))::DOUBLE / count(*), 6) AS stale_share, count(*) FILTER (50 - o_orderkey % 50 > 40) AS n_over_limit FROM orders GROUP BY 1""",
)
def _(spark, sf):
    rows = rollout.staleness(fx.groups(spark, sf).groupBy("group_id"), 40)
    return rows.withColumns({c: r6(c) for c in ("mean", "stale_share")})


@query("u1_concatenation", "SELECT o_custkey AS group_id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS vals FROM orders GROUP BY 1")
def _(spark, sf):
    rows = rollout.concatenated(fx.groups(spark, sf).withColumn("id", F.col("pos").cast("string")), "id")
    return rows.select("group_id", F.array_join("values", ",").alias("vals"))


@query(
    "u1_batches",
    """WITH o AS (SELECT o_custkey AS g, o_orderkey AS k, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS place FROM orders)
    SELECT (place // 64)::BIGINT AS batch, min(place)::BIGINT AS first, count(*)::INTEGER AS n, string_agg(g::VARCHAR, ',' ORDER BY place) AS ids, string_agg(k::VARCHAR, ',' ORDER BY place) AS vals FROM o GROUP BY 1""",
)
def _(spark, sf):
    steps = fx.groups(spark, sf).select(F.col("group_id").cast("string").alias("ids"), F.col("pos").cast("string").alias("vals"), "group_id", "pos")
    rows = rollout.batches(steps, ["ids", "vals"], 64, "group_id", "pos")
    return rows.select("batch", "first", "n", F.array_join("ids", ",").alias("ids"), F.array_join("vals", ",").alias("vals"))


@query(
    "w4_place_in_batch",
    "SELECT o_custkey AS group_id, o_orderkey AS pos, (row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1)::BIGINT AS place, ((row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) // 64)::BIGINT AS batch FROM orders",
)
def _(spark, sf):
    rows = rollout.in_batch_order(fx.groups(spark, sf).select("group_id", "pos"), "group_id", "pos")
    return rows.withColumn("batch", F.floor(F.col("place") / 64))


@query(
    "e10_fan_out",
    """WITH o AS (SELECT o_custkey AS g, o_orderkey AS k, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders)
    SELECT g AS group_id, k AS pos, k = l AS is_last, (l % 1000)::BIGINT AS advantage_of_last FROM o""",
)
def _(spark, sf):
    steps = fx.groups(spark, sf).select("group_id", "pos", (F.col("pos") % 1000).alias("advantage"))
    last = steps.groupBy("group_id").agg(F.max("pos").alias("last"))
    flagged = steps.join(last, "group_id").select("group_id", "pos", "advantage", (F.col("pos") == F.col("last")).alias("is_last"))
    return rollout.fanned_out(flagged, "advantage", "is_last", "group_id", "pos").drop("advantage")


@query("u2_all_or_none", "SELECT count(o_orderkey % 50) IN (0, count(*)) AS ok FROM orders")
def _(spark, sf):
    return rollout.all_or_none(fx.groups(spark, sf), "scheduled_step")


@query("w7_first_call_thought", f"WITH {CH} SELECT traj, pos, (i - 1)::INTEGER AS i, CASE WHEN i = 1 THEN 'thought ' || pos END AS thought FROM (SELECT traj, pos, unnest(range(1, n + 1)) AS i FROM ch WHERE n > 0)")
def _(spark, sf):
    calls = fx.chat(spark, sf).where("tool_calls is not null").select(F.struct(F.col("traj_id"), F.col("pos")).alias("response_id"), F.concat(F.lit("thought "), "pos").alias("thought"), F.col("tool_calls").alias("calls"))
    return rollout.first_call_carries_thought(calls).select(F.col("response_id.traj_id").alias("traj"), "response_id.pos", "i", "thought")


# --- diffs -------------------------------------------------------------------------------------------------------------
@query(
    "x1_patch_targets",
    f"""WITH {PQ}, c AS (SELECT o, p, q, 'src/m' || p || '.py' AS own, row_number() OVER (PARTITION BY o ORDER BY p) AS rn FROM pq),
    h AS (SELECT o, p, q, last_value(CASE WHEN p % 13 <> 0 THEN own END IGNORE NULLS) OVER (PARTITION BY o ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM c)
    SELECT o AS instance_id, f AS file, (p + 1)::INTEGER AS old_start, q AS old_count FROM h WHERE f IS NOT NULL""",
)
def _(spark, sf):
    return diff.old_side_targets(fx.patches(spark, sf)).select("instance_id", "file", "old_start", "old_count")


@query("x2_patch_hunks", f"WITH {PQ} SELECT o AS instance_id, 'src/m' || p || '.py' AS file, (p + 1)::INTEGER AS old_start, q AS old_count, (p + 2)::INTEGER AS new_start, q AS new_count FROM pq")
def _(spark, sf):
    return diff.file_hunks(fx.patches(spark, sf)).select("instance_id", "file", "old_start", "old_count", "new_start", "new_count")


@query("x3_parsed_patch", f"WITH {PQ} SELECT o AS instance_id, string_agg('src/m' || p || '.py:' || (p + 1) || ',' || q || ',' || (p + 2) || ',' || q, ' ' ORDER BY p) AS files FROM pq GROUP BY o")
def _(spark, sf):
    hunk = lambda h: F.array_join(F.array(*[h[n].cast("string") for n in diff.SIDES]), ",")
    file = lambda f: F.concat(f["file"], F.lit(":"), F.array_join(F.transform(f["hunks"], hunk), ";"))
    return fx.patches(spark, sf).select("instance_id", F.array_join(F.transform(diff.parsed_files(F.col("patch")), file), " ").alias("files"))


def _two_hunks(spark, sf):
    """Patches of two hunks a file; every id stands in two rows."""
    again = F.regexp_replace("patch", "@@ -([0-9]+)((?:,[0-9]+)?) \\+([0-9]+)((?:,[0-9]+)?) @@\n-old\n\\+new", "@@ -$1$2 +$3$4 @@\n-old\n+new\n@@ -9$1,3 +9$3 @@\n x")
    return fx.patches(spark, sf).select(F.floor(F.col("instance_id") / 2).alias("instance_id"), again.alias("patch"), F.col("instance_id").alias("row"))


@query(
    "x1_repeated_ids",
    f"""WITH {PQ}, c AS (SELECT o, p, q, last_value(CASE WHEN p % 13 <> 0 THEN 'src/m' || p || '.py' END IGNORE NULLS) OVER (PARTITION BY o ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM pq)
    SELECT o // 2 AS instance_id, f AS file, (p + 1)::INTEGER AS old_start, q AS old_count FROM c WHERE f IS NOT NULL
    UNION ALL SELECT o // 2, f, ('9' || (p + 1))::INTEGER, 3 FROM c WHERE f IS NOT NULL""",
)
def _(spark, sf):
    return diff.old_side_targets(_two_hunks(spark, sf)).select("instance_id", "file", "old_start", "old_count")


@query(
    "a21_two_hunks",
    f"""WITH {PQ} SELECT o // 2 AS instance_id, 'src/m' || p || '.py' AS file, least(p + 1, ('9' || (p + 1))::INTEGER)::INTEGER AS old_start,
    (greatest(p + q, ('9' || (p + 1))::INTEGER + 2) - (p + 1) + 1)::INTEGER AS old_count, (p + 2)::INTEGER AS new_start,
    (greatest(p + 1 + q, ('9' || (p + 2))::INTEGER) - (p + 2) + 1)::INTEGER AS new_count, 2::BIGINT AS n_hunks FROM pq""",
)
def _(spark, sf):
    return diff.file_extents(_two_hunks(spark, sf))


@query("a21_file_extents", f"WITH {PQ} SELECT o AS instance_id, 'src/m' || p || '.py' AS file, (p + 1)::INTEGER AS old_start, q AS old_count, (p + 2)::INTEGER AS new_start, q AS new_count, 1::BIGINT AS n_hunks FROM pq")
def _(spark, sf):
    return diff.file_extents(fx.patches(spark, sf))


@query(
    "p1_target_column",
    f"""WITH {PQ}, h AS (SELECT o, p, last_value(CASE WHEN p % 13 <> 0 THEN p END IGNORE NULLS) OVER (PARTITION BY o ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM pq)
    SELECT h.o AS instance_id, coalesce(string_agg('src/m' || f || '.py:' || (h.p + 1) || ',' || q, ' ' ORDER BY h.p) FILTER (f IS NOT NULL), '') AS target FROM h JOIN pq ON h.o = pq.o AND h.p = pq.p GROUP BY h.o""",
)
def _(spark, sf):
    rows = diff.targets_column(fx.patches(spark, sf))
    shown = lambda t: F.concat(t["file"], F.lit(":"), t["old_start"].cast("string"), F.lit(","), t["old_count"].cast("string"))
    return rows.select("instance_id", F.array_join(F.transform("target", shown), " ").alias("target"))


@query(
    "w1_carried_file",
    f"""WITH {PQ}, c AS (SELECT o, p, q, 'src/m' || p || '.py' AS own FROM pq),
    h AS (SELECT o, p, q, last_value(CASE WHEN p % 13 <> 0 THEN own END IGNORE NULLS) OVER (PARTITION BY o ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM c)
    SELECT o AS instance_id, f AS file, (p + 1)::INTEGER AS old_start, q AS old_count FROM h WHERE f IS NOT NULL""",
)
def _(spark, sf):
    parts = order.parts_of(fx.table(spark, sf, "lineitem"), 2)  # a header and a hunk a part
    return diff.targets_of_lines(diff.patch_lines(fx.patches(spark, sf)), parts=parts).drop("pos")


@query(
    "x3_patch_info",
    f"""WITH {PQ} SELECT o AS instance_id, string_agg('src/m' || p || '.py:9' || (p + 1) || ',' || q || ',9' || (p + 2) || ',' || q || ' 1', ' ' ORDER BY p) AS files FROM pq GROUP BY o""",
)
def _(spark, sf):
    again = F.regexp_replace("patch", "@@ -([0-9]+)((?:,[0-9]+)?) \\+([0-9]+)", "@@ -9$1$2 +9$3")  # each path twice: the second counts
    rows = diff.with_patch_info(fx.patches(spark, sf).select("instance_id", F.concat("patch", again).alias("patch")))
    number = lambda e: F.array_join(F.array(*[e["value"][n].cast("string") for n in diff.SIDES]), ",")
    shown = F.transform(F.map_entries("patch_info"), lambda e: F.concat(e["key"], F.lit(":"), number(e), F.lit(" "), F.size(e["value"]["hunks"]).cast("string")))
    return rows.select("instance_id", F.array_join(shown, " ").alias("files"))


# --- answers -----------------------------------------------------------------------------------------------------------
AW = f"""{PQ}, aw AS (SELECT o, p, 'src/m' || (p % 97) || '.py' AS file,
    CASE WHEN p % 3 = 2 THEN NULL ELSE 'C' || (p % 5) END AS cls, CASE p % 3 WHEN 0 THEN 'f' || (p % 11) WHEN 1 THEN '__init__' ELSE 'g' || (p % 7) END AS fn FROM pq),
    en AS (SELECT o, file, CASE WHEN cls IS NULL THEN file || ':' || fn WHEN fn = '__init__' THEN file || ':' || cls ELSE file || ':' || cls || '.' || fn END AS e,
    CASE WHEN cls IS NULL THEN file || ':' || fn ELSE file || ':' || cls END AS m FROM aw)"""


@query("x4_answer_locations", f'WITH {AW} SELECT o AS traj_id, file, cls AS "class", fn AS "function" FROM aw')
def _(spark, sf):
    return an.locations(fx.answers(spark, sf)).select("traj_id", "file", "class", "function")


@query("x5_entities", f"WITH {AW} SELECT DISTINCT o AS traj_id, e AS entity FROM en")
def _(spark, sf):
    return an.locations(fx.answers(spark, sf)).select("traj_id", an.entity(F.col("file"), F.col("class"), F.col("function")).alias("entity")).distinct()


@query("x6_modules", f"WITH {AW} SELECT DISTINCT o AS traj_id, m AS module FROM en")
def _(spark, sf):
    return an.locations(fx.answers(spark, sf)).select("traj_id", an.module(an.entity(F.col("file"), F.col("class"), F.col("function"))).alias("module")).distinct()


@query("w2_carried_class", f'WITH {AW} SELECT o AS traj_id, file, cls AS "class", fn AS "function" FROM aw')
def _(spark, sf):
    parts = order.parts_of(fx.table(spark, sf, "lineitem"), 3)  # three lines a part
    return an.locations_of_lines(an.answer_lines(fx.answers(spark, sf)), parts=parts).select("traj_id", "file", "class", "function")


@query(
    "x7_unparsable_answers",
    f"""WITH {AW}, g AS (SELECT o, string_agg(DISTINCT file, ' ' ORDER BY file) AS f, string_agg(DISTINCT e, ' ' ORDER BY e) AS e FROM en GROUP BY o)
    SELECT o AS traj_id, CASE WHEN o % 4 <> 0 THEN f END AS files, CASE WHEN o % 4 <> 0 THEN e END AS entities FROM g""",
)
def _(spark, sf):
    nameless = F.when(F.col("traj_id") % 4 == 0, F.concat(F.rtrim("answer", F.lit("`")), F.lit("\nmethod: \n```"))).otherwise(F.col("answer"))
    sets = an.answer_sets(fx.answers(spark, sf).withColumn("answer", nameless))
    return sets.select("traj_id", *[F.array_join(c, " ").alias(c) for c in ("files", "entities")])


@query(
    "x7_answer_sets",
    f"WITH {AW} SELECT o AS traj_id, string_agg(DISTINCT file, ' ' ORDER BY file) AS files, string_agg(DISTINCT m, ' ' ORDER BY m) AS modules, string_agg(DISTINCT e, ' ' ORDER BY e) AS entities FROM en GROUP BY o",
)
def _(spark, sf):
    return an.answer_sets(fx.answers(spark, sf)).select("traj_id", *[F.array_join(c, " ").alias(c) for c in ("files", "modules", "entities")])


@query("x4_repeated_ids", f'WITH {AW} SELECT o // 2 AS traj_id, file, cls AS "class", fn AS "function" FROM aw')
def _(spark, sf):
    rows = fx.answers(spark, sf).withColumn("traj_id", F.floor(F.col("traj_id") / 2))
    return an.locations(rows).select("traj_id", "file", "class", "function")


@query(
    "x8_tagged_files",
    f"WITH {RP} SELECT conv_id, turn, CASE WHEN form IN (0, 1) THEN word || ',b.py' WHEN form = 2 THEN '' END AS files FROM rp",
)
def _(spark, sf):
    return fx.replies(spark, sf).select("conv_id", "turn", F.when(an.tagged_files(F.col("reply")).isNotNull(), F.array_join(an.tagged_files(F.col("reply")), ",")).alias("files"))


@query("x9_normalized_paths", "SELECT o_orderkey, 'src/o' || o_orderkey || '.py' AS path FROM orders")
def _(spark, sf):
    raw = F.concat(F.lit(" \t./src/o"), F.col("o_orderkey").cast("string"), F.lit(".py\n"))
    return fx.table(spark, sf, "orders").select("o_orderkey", text.normalize_path(raw).alias("path"))


@query("x10_fenced_block", f"WITH {RP} SELECT conv_id, turn, word AS block FROM rp WHERE form IN (4, 5)")
def _(spark, sf):
    return fx.replies(spark, sf).where("form in (4, 5)").select("conv_id", "turn", text.fenced_or_whole(F.col("reply")).alias("block"))


@query("x11_reasoning_split", f"WITH {RP} SELECT conv_id, turn, CASE WHEN form = 3 THEN 'why ' || word END AS reasoning, word AS content FROM rp WHERE form IN (3, 5)")
def _(spark, sf):
    both = text.reasoning_and_content(F.col("reply"))
    return fx.replies(spark, sf).where("form in (3, 5)").select("conv_id", "turn", both["reasoning"].alias("reasoning"), both["content"].alias("content"))


@query(
    "x12_tool_arguments",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN 'src/' || o_orderkey END AS path, o_orderkey % 4 >= 2 AS failed FROM orders""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    plain = F.concat(F.lit('{"path": "src/'), k.cast("string"), F.lit('"}'))
    twice = F.concat(F.lit('"{\\"path\\": \\"src/'), k.cast("string"), F.lit('\\"}"'))
    raw = F.when(k % 4 == 0, plain).when(k % 4 == 1, twice).when(k % 4 == 2, "[1, 2]").otherwise("{broken")
    got = text.tool_arguments(raw)
    return fx.table(spark, sf, "orders").select("o_orderkey", got["arguments"]["path"].alias("path"), got["error"].isNotNull().alias("failed"))


@query(
    "x13_hit_files",
    """WITH f AS (SELECT DISTINCT 'src/m' || (l_partkey % 97) || '.py' AS f FROM lineitem), t AS (SELECT f FROM f ORDER BY f LIMIT 20)
    SELECT (SELECT count(*) FROM f) AS n_files, (SELECT string_agg(f, chr(10) ORDER BY f) FROM t) || CASE WHEN (SELECT count(*) FROM f) > 20 THEN chr(10) || '...' ELSE '' END AS display""",
)
def _(spark, sf):
    hit = F.concat(F.lit("src/m"), (F.col("l_partkey") % 97).cast("string"), F.lit(".py:"), F.col("l_linenumber").cast("string"), F.lit(":text: more"))
    return sources.hit_files(fx.table(spark, sf, "lineitem").select(hit.alias("hit"))).select("n_files", "display")


@query("x14_step_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE (o_orderkey % 1000)::INTEGER END AS step FROM orders")
def _(spark, sf):
    folder = F.when(F.col("o_orderkey") % 3 == 0, "step_x").otherwise(F.concat(F.lit("step_"), (F.col("o_orderkey") % 1000).cast("string")))
    return fx.table(spark, sf, "orders").select("o_orderkey", text.step_number(folder).alias("step"))


@query("e7_working_directory", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '/w/org_repo_' || o_orderkey ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'own' END END AS cwd, 'ls' AS command FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    plain, own = F.create_map(F.lit("command"), F.lit("ls")), F.create_map(F.lit("command"), F.lit("ls"), F.lit("cwd"), F.lit("own"))
    rows = fx.table(spark, sf, "orders").select("o_orderkey", F.when(k % 2 == 0, own).otherwise(plain).alias("args"), F.when(k % 3 == 0, "bash").otherwise("grep").alias("tool"))
    done = text.with_working_directory(F.col("args"), F.col("tool"), F.lit("org/repo"), k.cast("string"), "/w/")
    return rows.select("o_orderkey", done["cwd"].alias("cwd"), done["command"].alias("command"))


@query("x15_template", "SELECT doc_id AS instance_id, 'Fix c' || doc_id || ' in /w.' AS prompt FROM documents")
def _(spark, sf):
    return fx.instances(spark, sf).select("instance_id", text.rendered("Fix {{ instance.commit }} in {{ working_dir }}.", **{"instance.commit": F.col("base_commit"), "working_dir": F.lit("/w")}).alias("prompt"))


@query(
    "x16_command_classes",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'error' WHEN 2 THEN 'empty' WHEN 3 THEN 'long' ELSE 'ok' END AS class FROM orders""",
)
def _(spark, sf):
    k = F.col("o_orderkey") % 5
    out = F.when(k == 2, "").when(k == 3, F.repeat(F.lit("x"), F.lit(201))).otherwise("done")
    return fx.table(spark, sf, "orders").select("o_orderkey", text.command_result(F.when(k == 1, 2).otherwise(0), out, F.lit(""), k == 0).alias("class"))


@query("o10_display_caps", "SELECT o_custkey, CASE WHEN count(*) > 3 THEN true ELSE false END AS cut FROM orders GROUP BY 1")
def _(spark, sf):
    lists = fx.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))).alias("items"))
    return lists.select("o_custkey", sources.display(F.col("items"), 3).endswith("...").alias("cut"))


@query("o9_sorted_distinct", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS names FROM orders GROUP BY 1")
def _(spark, sf):
    return fx.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("names"))


# --- preparation -------------------------------------------------------------------------------------------------------
@query("p2_prompt", "SELECT doc_id AS instance_id, 'user' AS role, text AS content FROM documents")
def _(spark, sf):
    rows = prep.with_prompt(fx.instances(spark, sf))
    return rows.select("instance_id", F.get("prompt", F.lit(0))["role"].alias("role"), F.get("prompt", F.lit(0))["content"].alias("content"))


@query(
    "p3_evaluation_row",
    f"""WITH {PQ} SELECT o AS instance_id, 2::BIGINT AS n_messages, 512 AS max_tokens, 20 AS max_tool_calls, string_agg('src/m' || p || '.py', ',' ORDER BY p) AS files,
    sum(p + 1)::BIGINT AS old_starts, count(*) AS n_hunks, round(CASE WHEN count(*) = 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE / (count(*) + 1) END, 6) AS f1_of_first FROM pq GROUP BY o""",
)
def _(spark, sf):
    rows = fx.patches(spark, sf).withColumn("problem_statement", F.lit("p")).withColumn("repo", F.lit("r"))
    done = prep.with_evaluation_row(rows, "You find files.", 512, 20).withColumn("files", prep.answer_files(F.col("answer")))
    span = "struct<old_start:int,old_count:int,new_start:int,new_count:int,hunks:array<struct<old_start:int>>>"
    done = done.withColumn("spans", F.map_values(F.from_json("answer", f"map<string,{span}>")))
    files = F.col("files")
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, v: a + v["old_start"])
    hunks = F.aggregate("spans", F.lit(0).cast("long"), lambda a, v: a + F.size(v["hunks"]))
    said = F.array(F.concat(F.lit("./"), F.get(files, F.lit(0))))  # an answer that names the first file only
    score = scoring.set_f1(F.transform(said, text.normalize_path), files, 1.0)
    return done.select("info.instance_id", F.size("prompt").cast("long").alias("n_messages"), "info.max_tokens", "info.max_tool_calls", F.array_join(files, ",").alias("files"), total.alias("old_starts"), hunks.alias("n_hunks"), r6(score).alias("f1_of_first"))


@query("p4_project", "SELECT doc_id AS instance_id, lang || '/' || source AS repo, 'c' || doc_id AS base_commit FROM documents")
def _(spark, sf):
    return fx.instances(spark, sf).select("instance_id", "repo", "base_commit")


@query("p6_checkout_name", "SELECT doc_id AS instance_id, lang || '_' || source || '_' || doc_id AS name FROM documents")
def _(spark, sf):
    return fx.instances(spark, sf).select("instance_id", text.checkout_name(F.col("repo"), F.col("instance_id").cast("string")).alias("name"))


@query("p7_truncate", "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS shown FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.truncated(F.col("text")).alias("shown"))


@query("f6_by_id", "SELECT doc_id AS instance_id, 'c' || doc_id AS base_commit FROM documents WHERE doc_id = 17")
def _(spark, sf):
    return prep.by_id(fx.instances(spark, sf), "instance_id", 17).select("instance_id", "base_commit")


@query("f7_by_ordinal", "SELECT doc_id AS instance_id FROM documents ORDER BY doc_id LIMIT 1 OFFSET 42")
def _(spark, sf):
    return prep.by_ordinal(fx.instances(spark, sf), [F.col("instance_id")], 42).select("instance_id")


REPOS = "r AS (SELECT lang || '/' || source AS repo, min(doc_id) AS first FROM documents GROUP BY 1), k AS (SELECT repo FROM r ORDER BY first LIMIT 5)"


@query("f9_first_repos", f"WITH {REPOS} SELECT doc_id AS instance_id, lang || '/' || source AS repo FROM documents WHERE lang || '/' || source IN (SELECT repo FROM k)")
def _(spark, sf):
    return prep.first_n_keys(fx.instances(spark, sf), "repo", "instance_id", 5).select("instance_id", "repo")


@query("w6_first_appearance", "WITH r AS (SELECT lang || '/' || source AS repo, min(doc_id) AS first FROM documents GROUP BY 1) SELECT repo, (SELECT count(*) FROM r b WHERE b.first <= r.first)::INTEGER AS rank FROM r")
def _(spark, sf):
    first = fx.instances(spark, sf).groupBy("repo").agg(F.min("instance_id").alias("first"))
    return first.select("repo", F.dense_rank().over(Window.orderBy("first")).alias("rank"))  # a row per repository


@query("j2_instance_of_trajectory", "SELECT e.user_id AS traj_id, d.lang || '/' || d.source AS repo, count(*) AS n FROM events e JOIN documents d ON d.doc_id = e.user_id GROUP BY 1, 2")
def _(spark, sf):
    rows = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("traj_id")).agg(F.count("*").alias("n"))
    return rows.join(fx.instances(spark, sf).select(F.col("instance_id").alias("traj_id"), "repo"), "traj_id").select("traj_id", "repo", "n")


@query("j3_positional_zip", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders")
def _(spark, sf):
    lists = fx.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("s"))
    zipped = F.arrays_zip(F.transform("s", lambda x: x["o_orderkey"]).alias("k"), F.transform("s", lambda x: x["o_orderpriority"]).alias("p"))
    return lists.select("o_custkey", F.explode(zipped).alias("z")).select("o_custkey", F.col("z.k").alias("o_orderkey"), F.col("z.p").alias("o_orderpriority"))


@query(
    "j3_zipped_tables",
    """WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders), b AS (SELECT o_orderkey AS other, o_custkey, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS i FROM orders)
    SELECT o_orderkey, other, o_custkey FROM a JOIN b ON a.i = b.i""",
)
def _(spark, sf):
    orders = fx.table(spark, sf, "orders")
    others = orders.select(F.col("o_orderkey").alias("other"), "o_custkey")
    return order.zipped(orders.select("o_orderkey", "o_totalprice"), others, ["o_totalprice", "o_orderkey"], [-F.col("o_custkey"), "other"]).select("o_orderkey", "other", "o_custkey")


@query("j4_semi_join", f"WITH {REPOS} SELECT count(*) AS n FROM documents WHERE lang || '/' || source IN (SELECT repo FROM k)")
def _(spark, sf):
    return prep.first_n_keys(fx.instances(spark, sf), "repo", "instance_id", 5).agg(F.count("*").alias("n"))


@query("o3_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def _(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").limit(25)


@query("o4_shuffle_unseeded", "SELECT doc_id AS instance_id FROM documents")
def _(spark, sf):
    return prep.shuffled(fx.instances(spark, sf), "instance_id").select("instance_id")


@query("o5_shuffle_seeded", "SELECT doc_id AS instance_id FROM documents")
def _(spark, sf):
    return prep.shuffled(fx.instances(spark, sf), "instance_id", 42).select("instance_id")


@query("o6_tail_split", "WITH n AS (SELECT count(*) AS n FROM documents) SELECT 'validation' AS split, least(100, n) AS n_rows FROM n UNION ALL SELECT 'train', n - least(100, n) FROM n WHERE n > 100")
def _(spark, sf):
    return prep.tail_split(fx.instances(spark, sf), prep.by_hash("instance_id", 42)).groupBy("split").agg(F.count("*").alias("n_rows"))


@query(
    "o6_split_with_ties",
    """WITH n AS (SELECT count(*) AS n FROM documents), k AS (SELECT lang, source, count(*) AS m FROM documents GROUP BY ALL), c AS (
    SELECT lang, source, m, coalesce(sum(m) OVER (ORDER BY lang DESC, source DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM k), h AS (
    SELECT lang, source, m, greatest(0, least(m, 100 - after)) AS held FROM c)
    SELECT lang, source, 'validation' AS split, held::BIGINT AS n_rows FROM h WHERE held > 0 UNION ALL SELECT lang, source, 'train', (m - held)::BIGINT FROM h WHERE m > held""",
)
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return prep.tail_split(docs, [F.col("lang"), F.col("source")]).groupBy("lang", "source", "split").agg(F.count("*").alias("n_rows"))


@query("o7_ratio_split", "WITH n AS (SELECT count(*) AS n FROM documents) SELECT 'test' AS split, ceil(n * 0.2)::BIGINT AS n_rows FROM n UNION ALL SELECT 'train', n - ceil(n * 0.2)::BIGINT FROM n")
def _(spark, sf):
    return prep.ratio_split(fx.instances(spark, sf), "instance_id").groupBy("split").agg(F.count("*").alias("n_rows"))


@query(
    "o8_mode_select",
    """WITH n AS (SELECT count(*) AS n, ceil(count(*) * 0.2)::BIGINT AS t FROM documents)
    SELECT 'train' AS mode, 'train' AS split, n - t AS n_rows FROM n UNION ALL SELECT 'test', 'test', t FROM n UNION ALL SELECT 'full', 'train', n - t FROM n UNION ALL SELECT 'full', 'test', t FROM n""",
)
def _(spark, sf):
    rows = prep.ratio_split(fx.instances(spark, sf), "instance_id")
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    of = lambda mode: prep.select_mode(train, test, mode).groupBy(F.lit(mode).alias("mode"), "split").agg(F.count("*").alias("n_rows"))
    return of("train").unionByName(of("test")).unionByName(of("full"))


@query("a23_success_count", "SELECT count(*) FILTER (o_orderstatus = 'F') AS n_ok, count(*) AS n FROM orders")
def _(spark, sf):
    return fx.table(spark, sf, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_ok"), F.count("*").alias("n"))


# --- sources, sinks and the report -------------------------------------------------------------------------------------
@query(
    "s1_k1_named_split",
    "SELECT doc_id AS instance_id, CASE WHEN row_number() OVER (ORDER BY doc_id DESC) <= 100 THEN 'validation' ELSE 'train' END AS split FROM documents",
)
def _(spark, sf):
    root = sources.scratch_folder(spark, "splits")
    sources.write_splits(prep.tail_split(fx.instances(spark, sf), [F.col("instance_id")]), root, "org/set", "test")
    both = [sources.read_split(spark, root, "org/set", f"test/{part}.parquet").select("instance_id", F.lit(part).alias("split")) for part in ("train", "validation")]
    return both[0].unionByName(both[1])


def _written_runs(spark, sf) -> str:
    """The trajectory documents as a tree of files: every tenth run is an error."""
    rows = run_trajectories(spark, sf).withColumn("messages", F.col("messages").cast("array<struct<pos:bigint,kind:string>>"))
    t, root = F.col("id").cast("long"), sources.scratch_folder(spark, "runs")
    rows = rows.select("step", "phase", F.col("id").alias("instance_id"), F.lit(0).alias("repetition_id"), "target", "final_message", "reward_dict", F.transform("messages", lambda m: F.struct(m["kind"].alias("kind"))).alias("messages"), F.when(t % 10 == 3, F.concat(F.lit("failed "), "id")).alias("error"))
    sources.write_trajectories(rows, root)
    return root


@query(
    "s3_s4_k2_trajectory_tree",
    """WITH tr AS (SELECT user_id AS u, count(*) FILTER (event_type IN ('view','click')) AS ct FROM events GROUP BY 1)
    SELECT (u % 5)::INTEGER AS step, CASE WHEN u % 2 = 0 THEN 'train' ELSE 'eval' END AS phase, u || '_0' AS id, ct AS "count_TokenEvent", round((u % 7)::DOUBLE + 0.5::DOUBLE, 6) AS reward FROM tr WHERE u % 10 <> 3""",
)
def _(spark, sf):
    rows = rp.report(sources.read_trajectories(spark, _written_runs(spark, sf)))
    return rows.select("step", "phase", "id", "count_TokenEvent", r6("total_reward").alias("reward"))


def _tree_with_rejects(spark, sf) -> str:
    """The tree, with names that need encoding, and documents that can't be read for every tenth run: broken, a list, empty, of another type."""
    rows, root = run_trajectories(spark, sf), sources.scratch_folder(spark, "rejects")
    t = F.col("id").cast("long")
    kinds = F.transform("messages", lambda m: F.struct(m["kind"].alias("kind")))
    good = F.to_json(F.struct("reward_dict", kinds.alias("messages"), "final_message"))
    body = F.when(t % 40 == 3, "{ broken").when(t % 40 == 13, "[1, 2]").when(t % 40 == 23, "").when(t % 40 == 33, '{"messages": "none"}').otherwise(good)
    sources.write_files(rows.select(F.concat(F.lit("step_"), "step", F.lit("/"), "phase", F.lit("/run "), "id", F.lit("+b%2.json")).alias("name"), body.alias("body")), root)
    return root


@query(
    "s4_report_and_rejects",
    """WITH tr AS (SELECT user_id AS u, count(*) FILTER (event_type IN ('view','click')) AS ct FROM events GROUP BY 1), x AS (
    SELECT u, (u % 5)::INTEGER AS step, CASE WHEN u % 2 = 0 THEN 'train' ELSE 'eval' END AS phase, 'run ' || u || '+b%2' AS id, ct FROM tr)
    SELECT step, phase, id, CASE u % 40 WHEN 3 THEN 'not a JSON document' WHEN 13 THEN 'not an object' WHEN 23 THEN 'empty file' WHEN 33 THEN 'a field has an unexpected type' END AS reason,
    CASE WHEN u % 10 <> 3 THEN ct END AS "count_TokenEvent" FROM x""",
)
def _(spark, sf):
    scan = sources.written(sources.scan_trajectories(spark, _tree_with_rejects(spark, sf)), "scan")
    rows = rp.report(scan.where("reason is null").drop("path", "reason"))
    parts = F.split("path", "/")
    refused = sources.rejects(scan).select(text.step_number(F.element_at(parts, -3)).alias("step"), F.element_at(parts, -2).alias("phase"), F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("id"), "reason")
    return rows.select("step", "phase", "id", F.lit(None).cast("string").alias("reason"), "count_TokenEvent").unionByName(refused.withColumn("count_TokenEvent", F.lit(None).cast("long")))


@query(
    "s3_converted_store",
    """WITH tr AS (SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1) SELECT (u % 5)::INTEGER AS step, CASE WHEN u % 2 = 0 THEN 'train' ELSE 'eval' END AS phase, u || '_0' AS id, n AS n_messages FROM tr WHERE u % 10 <> 3 AND u % 5 >= 2""",
)
def _(spark, sf):
    store = sources.scratch_folder(spark, "store")
    sources.convert_trajectories(spark, _written_runs(spark, sf), store)
    return sources.read_store(spark, store).where("step >= 2").select("step", "phase", "id", F.size("messages").cast("long").alias("n_messages"))


@query("k2_k3_errors", "SELECT DISTINCT 'failed ' || user_id AS error FROM events WHERE user_id % 10 = 3")
def _(spark, sf):
    root = sources.scratch_folder(spark, "errors")
    runs = run_trajectories(spark, sf).withColumn("error", F.when(F.col("id").cast("long") % 10 == 3, F.concat(F.lit("failed "), "id")))
    sources.write_errors(runs, root)
    return spark.read.text(root).select(F.col("value").alias("error"))


@query("k5_report_csv", "SELECT DISTINCT (user_id % 5)::VARCHAR AS step, user_id::VARCHAR AS id FROM events")
def _(spark, sf):
    root = sources.scratch_folder(spark, "csv")
    sources.write_report_csv(rp.report(run_trajectories(spark, sf)), root, "step", "id")
    return spark.read.option("header", True).csv(root).select("step", "id")


@query("k6_events_jsonl", f"WITH {EV} SELECT traj AS traj_id, pos, kind, CASE WHEN kind = 'TokenEvent' THEN np END AS n_prompt FROM ev")
def _(spark, sf):
    root = sources.scratch_folder(spark, "jsonl")
    sources.write_events_jsonl(fx.events(spark, sf).select("traj_id", "pos", "kind", "prompt_token_ids"), root)
    back = spark.read.schema("traj_id bigint, pos bigint, kind string, prompt_token_ids array<int>").json(root)
    return back.select("traj_id", "pos", "kind", F.size("prompt_token_ids").cast("long").alias("n_prompt"))


@query("s7_listing", "SELECT count(DISTINCT user_id) AS n_files, 0::BIGINT AS n_python FROM events")
def _(spark, sf):
    return sources.list_directory(spark, _written_runs(spark, sf)).select("n_files", "n_python")


@query("s2_parquet_scan", "SELECT count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("s6_event_snapshot", f"WITH {EV} SELECT kind, count(*) AS n FROM ev GROUP BY kind")
def _(spark, sf):
    return fx.events(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query("s6_snapshot_of_one_run", f"WITH {EV} SELECT traj AS traj_id, pos, kind, CASE WHEN kind = 'TokenEvent' THEN np END AS n_prompt FROM ev WHERE traj = (SELECT min(user_id) FROM events)")
def _(spark, sf):
    log = fx.events(spark, sf)
    one = log.join(F.broadcast(log.agg(F.min("traj_id").alias("traj_id"))), "traj_id", "left_semi")  # one row
    state = [row.asDict() for row in one.select("traj_id", "pos", "kind", "prompt_token_ids").collect()]  # one run's events, as an agent holds them
    return sources.snapshot(spark, state).select("traj_id", "pos", "kind", F.size("prompt_token_ids").cast("long").alias("n_prompt"))


@query(
    "s8_regex_search",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE lang = 'en')
    SELECT 'src/' || lpad(doc_id::VARCHAR, 9, '0') || '.py' AS path, line::INTEGER AS line, t AS text FROM l WHERE regexp_matches(t, '[Ll]icens') ORDER BY 1, 2 LIMIT 100""",
)
def _(spark, sf):
    path = F.concat(F.lit("src/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.when(F.col("lang") == "en", ".py").otherwise(".txt"))
    return sources.search_lines(fx.table(spark, sf, "documents").select(path.alias("path"), F.col("text").alias("content")), "[Ll]icens", "*.py")


@query(
    "s8_file_search",
    r"""WITH l AS (SELECT doc_id, doc_id % 7 AS b, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents), n AS (
    SELECT b, t, row_number() OVER (PARTITION BY b ORDER BY doc_id, i) AS line FROM l)
    SELECT 'bucket=' || b AS folder, line::BIGINT AS line, t AS text FROM n WHERE regexp_matches(t, '[Ll]icens') ORDER BY b, line LIMIT 100""",
)
def _(spark, sf):
    root = sources.scratch_folder(spark, "texts")
    docs = fx.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 7).alias("bucket"), F.posexplode(F.split("text", "\n")).alias("i", "value"))
    docs.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "i").select("bucket", "value").write.partitionBy("bucket").text(root)
    hits = sources.search_files(spark, root, "[Ll]icens", "*.txt")
    return hits.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "line", "text")


RPT = """tr AS (SELECT user_id AS u, user_id % 5 AS step, CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'eval' END AS phase,
    count(*) FILTER (event_type IN ('purchase','error')) AS ca, count(*) FILTER (event_type = 'signup') AS cm, count(*) FILTER (event_type IN ('view','click')) AS ct FROM events GROUP BY 1)"""


def run_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """Trajectory documents of the event fixture, as the tree reader gives them."""
    rows = fx.events(spark, sf).groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind"))).alias("messages"))
    t = F.col("traj_id")
    return rows.select(
        (t % 5).cast("int").alias("step"),
        F.when(t % 2 == 0, "train").otherwise("eval").alias("phase"),
        t.cast("string").alias("id"),
        "messages",
        F.create_map(F.lit("a"), (t % 7).cast("double"), F.lit("b"), F.lit(0.5)).alias("reward_dict"),
        F.repeat(F.lit("m"), (t % 700).cast("int")).alias("final_message"),
        F.lit("[]").alias("target"),
    )


@query(
    "p5_o1_report",
    f"""WITH {RPT} SELECT u::VARCHAR AS id, step::INTEGER AS step, phase, ca + cm + ct AS num_messages, (u % 7)::DOUBLE + 0.5::DOUBLE AS total_reward, ca AS "count_ActionEvent", cm AS "count_MessageEvent",
    ct AS "count_TokenEvent", CASE WHEN u % 700 > 500 THEN repeat('m', 500) || '...' ELSE repeat('m', (u % 700)::INTEGER) END AS final_message FROM tr""",
)
def _(spark, sf):
    return rp.report(run_trajectories(spark, sf))


def mixed_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.mixed_events(spark, sf).groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind"))).alias("messages"))
    t = F.col("traj_id")
    return rows.select((t % 5).cast("int").alias("step"), F.lit("train").alias("phase"), t.cast("string").alias("id"), "messages", F.create_map(F.lit("a"), (t % 7).cast("double")).alias("reward_dict"), F.lit(None).cast("string").alias("final_message"))


@query(
    "p5_found_kinds",
    f"""WITH {MX} SELECT traj::VARCHAR AS id, (traj % 5)::INTEGER AS step, 'train' AS phase, count(*) AS num_messages, (traj % 7)::DOUBLE AS total_reward, {MX_COUNTS}, '' AS final_message FROM mx GROUP BY traj""",
)
def _(spark, sf):
    return rp.report(mixed_trajectories(spark, sf))


@query(
    "k7_found_kinds",
    f"""WITH {MX} SELECT count(DISTINCT traj) AS n_trajectories, min(traj % 5)::INTEGER AS min_step, max(traj % 5)::INTEGER AS max_step, {MX_COUNTS.replace('"count_', '"sum_')},
    (SELECT round(avg((t % 7)::DOUBLE), 4) FROM (SELECT DISTINCT user_id AS t FROM events)) AS mean_reward FROM mx""",
)
def _(spark, sf):
    return rp.summary(rp.report(mixed_trajectories(spark, sf)))


@query("o2_head", f"WITH {RPT} SELECT step::INTEGER AS step, u::VARCHAR AS id FROM tr ORDER BY step, u::VARCHAR LIMIT 10")
def _(spark, sf):
    return rp.head(rp.report(run_trajectories(spark, sf))).select("step", "id")


@query(
    "k7_a24_summary",
    f"""WITH {RPT} SELECT count(*) AS n_trajectories, min(step)::INTEGER AS min_step, max(step)::INTEGER AS max_step, sum(ca)::BIGINT AS "sum_ActionEvent", sum(cm)::BIGINT AS "sum_MessageEvent",
    sum(ct)::BIGINT AS "sum_TokenEvent", round(avg((u % 7)::DOUBLE + 0.5::DOUBLE), 4) AS mean_reward FROM tr""",
)
def _(spark, sf):
    return rp.summary(rp.report(run_trajectories(spark, sf)))


@query("stream_windowed_kinds", f"WITH {EV} SELECT time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP AS start, kind, count(*) AS n FROM ev GROUP BY 1, 2")
def _(spark, sf):
    from .. import streaming

    rows = fx.events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.windowed_kinds(rows).withColumn("start", F.col("start").cast("timestamp_ntz"))
