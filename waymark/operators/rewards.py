"""Behavioural rewards and the registry they are composed from: names map to builders of columns, not to functions on rows.

A builder takes the columns it needs by name (turns, tool_calls, multilevel score parts, ...) and returns the score and
its named parts. Scores are null where the reference data would raise an error; the manager counts those as 0.0.
"""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tools
from .scoring import file_score, gold_levels, multilevel

Built = tuple[Column, dict[str, Column]]
REGISTRY: dict[str, Callable[..., Column | Built]] = {}


def reward(name: str):
    """Register a builder; a later one of the same name replaces it."""

    def keep(builder):
        REGISTRY[name] = builder
        return builder

    return keep


def get_reward(name: str) -> Callable[..., Column | Built]:
    if name not in REGISTRY:
        raise ValueError(f"unknown reward {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def half_cosine(t: Column, period: Column | float, low: Column | float, high: Column | float) -> Column:
    """low + (high - low) / 2 * (cos(pi t / period) + 1)."""
    low, high, period = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high, period))
    return low + F.lit(0.5) * (high - low) * (F.cos(F.lit(pi) * t / period) + F.lit(1.0))


@reward("multiturn_reward")
def multiturn(minimal_turns: int = 1) -> Column:
    return F.when(F.col("turns") > minimal_turns, 1.0).otherwise(0.0)


@reward("tool_use_reward")
def tool_use() -> Column:
    return F.coalesce(F.try_divide(F.col("tool_calls").cast("double"), F.col("turns").cast("double")), F.lit(0.0))


@reward("turn_efficiency")
def turn_efficiency(max_turns: int = 5) -> Column:
    over = F.lit(1.0) - F.lit(0.1) * (F.col("turns") - max_turns)
    return F.when((F.col("turns") <= 1) | (F.col("tool_calls") <= 1), 0.0).when(F.col("turns") <= max_turns, 1.0).otherwise(F.greatest(F.lit(0.0), over))


def _sign(found: Column) -> Column:
    return F.when(found >= 0.5, 5.0).otherwise(-5.0)


def cosine_turns(found: Column) -> Column:
    return F.when(F.col("turns") > 10, -10.0).otherwise(half_cosine(F.col("turns"), 10.0, 0.0, _sign(found)))


def cosine_calls(found: Column) -> Column:
    mean = F.col("tool_calls") / F.greatest(F.lit(1), F.col("turns"))
    return F.when(mean > 5, -10.0).otherwise(half_cosine(mean, 5.0, 0.0, _sign(found)))


@reward("cosine_reward")
def cosine(found: str | None = None, **weights: float) -> Built:
    """Turn and call rewards beside the multilevel localization's parts; a localization that failed counts 0.0 and has no parts.

    `found` names a column that holds the localization's score already.
    """
    if found is None:
        value, parts = multilevel_localization(**weights)
    else:
        value, parts = F.col(found), {}
    known = F.coalesce(value, F.lit(0.0))
    own = {"turn_cosine_reward": cosine_turns(known), "tool_cosine_reward": cosine_calls(known)}
    return own["turn_cosine_reward"] + own["tool_cosine_reward"], {name: F.when(value.isNotNull(), part) for name, part in parts.items()} | own


def _parsed(built: Built) -> Built:
    """Null, and without parts, for answers that could not be parsed (null sets)."""
    value, parts = built
    known = F.col("files").isNotNull()
    return F.when(known, value), {name: F.when(known, part) for name, part in parts.items()}


@reward("file_localization_f1_reward")
def file_localization(file_level_weight: float = 1.0) -> Built:
    value, parts = _parsed(file_score(F.col("files"), F.col("target"), file_level_weight))
    return F.when(F.col("target").isNotNull(), value), parts


@reward("multilevel_localization_f1_reward")
def multilevel_localization(file_level_weight: float = 1.0, module_level_weight: float = 1.0, entity_level_weight: float = 1.0) -> Built:
    predicted = {"file": F.col("files"), "module": F.col("modules"), "entity": F.col("entities")}
    return _parsed(multilevel(predicted, gold_levels(F.col("file_changes")), {"file": file_level_weight, "module": module_level_weight, "entity": entity_level_weight}))


def score(rows: DataFrame, configured: list[dict], final_message: str = "final_message") -> DataFrame:
    """rows with total_reward and reward_dict, from ``[{"fn": name, "args": {...}}, ...]`` in order.

    Scores are summed; parts are merged and a later key wins; a builder without parts is filed under its own name. A score
    that is null (where the reference data would raise), an unknown name or wrong arguments count 0.0 and are filed as that under the
    name, without parts. An empty final message makes the total -10.0 and leaves the parts.
    """
    none = F.lit(None).cast("double")
    total, parts = F.lit(0.0), {}
    for item in configured:
        name = item["fn"]
        try:
            built = get_reward(name)(**item.get("args", {}))
        except (TypeError, ValueError):
            built = none
        value, own = built if isinstance(built, tuple) else (built, {name: built})
        failed = value.isNull()
        total = total + F.coalesce(value, F.lit(0.0))
        for key, part in own.items():
            parts[key] = F.coalesce(F.when(~failed, part.cast("double")), parts.get(key, none))
        parts[name] = F.when(failed, F.lit(0.0)).otherwise(parts.get(name, none))
    pairs = [x for name, part in parts.items() for x in (F.lit(name), part)]
    merged = F.map_filter(F.create_map(*pairs).cast("map<string,double>"), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,double>")
    return rows.withColumn("total_reward", F.when(F.coalesce(F.col(final_message), F.lit("")) == "", -10.0).otherwise(total)).withColumn("reward_dict", merged)


DEFAULT_REWARDS = [{"fn": "multilevel_localization_f1_reward"}]
DEFAULT_TOOLS = ["terminal"]


def read_experiment(path: str) -> dict:
    """An experiment from a YAML file on the driver."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading experiment files needs PyYAML") from missing
    with open(path) as text:
        return load_experiment(yaml.safe_load(text) or {})


def load_experiment(config: dict | None) -> dict:
    """An experiment's rewards and tools replace the defaults, its prompts only if it has any; unknown names raise before anything runs."""
    chosen = {"reward": DEFAULT_REWARDS, "tools": DEFAULT_TOOLS, "prompts": {}}
    if config:
        chosen |= {"reward": config.get("reward", []), "tools": config.get("tools", [])} | ({"prompts": config["prompts"]} if config.get("prompts") else {})
    for item in chosen["reward"]:
        get_reward(item["fn"])
    for name in chosen["tools"]:
        tools.check(name)
    return chosen
