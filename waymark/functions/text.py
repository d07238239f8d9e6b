"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once: a lambda that names a column expression would work it out for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any script at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"^\n+|\n+$", "")


def normalize_path(path: Column) -> Column:
    """Trimmed, without one leading ``./``."""
    return F.regexp_replace(strip(path), r"^\./", "")


def truncated(text: Column, limit: int = 500) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def checkout_name(repo: Column, instance_id: Column) -> Column:
    """The folder of a checkout: slashes of the repository's name as underscores, then the instance."""
    return F.concat_ws("_", F.translate(repo, "/", "_"), instance_id)


def fenced_or_whole(text: Column) -> Column:
    """The first fenced block, empty ones too, or else the whole text."""
    fence = r"(?s)```(.*?)```"
    return F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text)


def reasoning_and_content(text: Column) -> Column:
    """struct(reasoning, content) of a reply that thinks first; without an end of thinking all is content."""
    before = F.substring_index(text, "</think>", 1)
    reasoning = F.regexp_replace(F.substring_index(F.regexp_replace(before, r"\n+$", ""), "<think>", -1), r"^\n+", "")
    content = F.regexp_replace(F.substring_index(text, "</think>", -1), r"^\n+", "")
    thinks = text.contains("</think>")
    return F.struct(F.when(thinks, reasoning).alias("reasoning"), F.when(thinks, content).otherwise(text).alias("content"))


def tool_arguments(raw: Column) -> Column:
    """struct(arguments map, error): an object, or an object that was encoded twice; anything else is an error row."""
    once = F.when(strip(raw).startswith('"'), F.get_json_object(raw, "$")).otherwise(raw)
    parsed = F.when(strip(once).startswith("{"), F.from_json(once, "map<string,string>", {"mode": "PERMISSIVE"}))
    parsed = F.when(F.map_contains_key(F.coalesce(parsed, F.create_map()), F.lit("")) & ~once.contains('""'), F.lit(None)).otherwise(parsed)
    return F.struct(parsed.alias("arguments"), F.when(parsed.isNull(), F.lit("Error: Invalid tool arguments - not a JSON object")).alias("error"))


def with_working_directory(arguments: Column, tool: Column, repo: Column, instance_id: Column, root: str, only: str = "bash") -> Column:
    """A tool call's arguments (a map), with the checkout's folder as `cwd` if it is the tool that needs one; an own `cwd` is replaced."""
    own = F.map_filter(arguments, lambda k, _: k != "cwd")
    placed = F.map_concat(own, F.create_map(F.lit("cwd"), F.concat(F.lit(root.rstrip("/") + "/"), checkout_name(repo, instance_id))))
    return F.when(tool == only, placed).otherwise(arguments)


def step_number(folder: Column) -> Column:
    """N of ``step_N``, 0 without a match."""
    return F.coalesce(F.regexp_extract(folder, "step_([0-9]+)", 1).try_cast("int"), F.lit(0))


def hit_file(line: Column) -> Column:
    """The path of a ``path:line:text`` search hit."""
    return F.substring_index(line, ":", 1)


def command_result(code: Column, out: Column, err: Column, timed_out: Column, limit: int = 200) -> Column:
    """Class of a command's outcome; `long` goes by characters."""
    return (
        F.when(timed_out, "timeout")
        .when(code != 0, "error")
        .when(F.length(F.concat(out, err)) == 0, "empty")
        .when(F.length(out) > limit, "long")
        .otherwise("ok")
    )


def rendered(template: str, **columns: Column) -> Column:
    """A template's ``{{ name }}`` places filled with columns."""
    out = F.lit(template)
    for name, column in columns.items():
        out = F.replace(out, F.lit("{{ " + name + " }}"), column)
    return out
