"""Free-text answers to files, modules and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import RANGE_ROWS, carried
from .text import let, normalize_path, strip


def answer_body(answer: Column) -> Column:
    return F.regexp_replace(F.coalesce(answer, F.lit("")), r"^[` \n]+|[` \n]+$", "")


def role(line: Column) -> Column:
    """What a trimmed line does: B blank, F file, C class, M function or method; null for any other."""
    is_function = line.startswith("function:") | line.startswith("method:")
    return F.when(line == "", "B").when(line.endswith(".py"), "F").when(line.startswith("class:"), "C").when(is_function, "M")


def after_colon(line: Column) -> Column:
    return strip(F.regexp_replace(line, "^[a-z]+:", ""))


def called(said: Column) -> Column:
    """The name in what follows a function line's colon: the first word, without brackets around it."""
    return F.regexp_replace(F.regexp_extract(said, r"(?U)^\S*", 0), r"^[()]+|[()]+$", "")


def named(file: Column, context: Column, said: Column, name: Column) -> list[Column]:
    dotted = name.contains(".")
    return [
        file.alias("file"),
        F.when(dotted, F.substring_index(name, ".", 1)).otherwise(context).alias("class"),
        F.when(dotted, F.regexp_replace(name, r"^[^.]*\.", "")).otherwise(name).alias("function"),
        (said == "").alias("bad"),
    ]


def location(file: Column, context: Column, said: Column) -> Column:
    """The location of a function line (what follows its colon), under a file and a class context."""
    return let(called(said), lambda name: F.struct(*named(file, context, said, name)))


def _function_lines(answer: Column) -> Column:
    """ARRAY<STRING> of an answer's function lines that have a file: ``M``, the file, the class context, and what follows the colon, a line each.

    The context's line begins with ``-`` if there is none, the others with a space. All lines are worked on at once, by patterns over the
    whole text: a function on each line would cost far more.
    """
    blank = r"[\s&&[^\n]]"
    text = F.regexp_replace(answer_body(answer), rf"(?mdU)^{blank}+|(?<!\s){blank}+$", "")
    # a space before each line, or else a letter for what the line does
    text = F.concat(F.lit("\n "), F.replace(text, F.lit("\n"), F.lit("\n ")))
    for pattern, letter in ((r"(.*\.py)$", "F$1"), (rf"class:{blank}*", "C"), (rf"(?:function|method):{blank}*", "M"), ("$", "B")):
        text = F.regexp_replace(text, f"(?mdU)^ {pattern}", letter)
    # the text is cut where a context begins, and then where a file does, and its function lines are given what holds for them
    head = lambda part: F.substring_index(part, "\n", 1)
    given = lambda part, what: F.replace(part, F.lit("\nM"), F.concat(F.lit("\nM\n"), what))
    of_context = lambda part: given(part, F.concat(F.when(part.startswith("C"), F.concat(F.lit(" "), F.substring(head(part), 2, 1 << 30))).otherwise("-"), F.lit("\n ")))
    text = F.array_join(F.transform(F.split(text, r"\n(?=[BCF])"), of_context), "\n")
    of_file = lambda part: given(part, F.concat(F.lit(" "), F.substring(head(part), 2, 1 << 30)))
    files = F.filter(F.split(text, r"\n(?=F)"), lambda part: part.startswith("F"))
    text = F.array_join(F.transform(files, of_file), "\n")
    return F.regexp_extract_all(text, F.lit(r"(?md)^M\n .*\n[- ].*\n .*$"), F.lit(0))


def _location(line: Column) -> Column:
    """The location of one of `_function_lines`."""
    rest = lambda c: F.substring(c, 2, 1 << 30)
    of = lambda w: location(rest(F.get(w, F.lit(1))), F.when(F.get(w, F.lit(2)).startswith(" "), rest(F.get(w, F.lit(2)))), rest(F.get(w, F.lit(3))))
    return let(F.split(line, "\n"), of)


def location_list(answer: Column) -> Column:
    """ARRAY<STRUCT<file, class, function, bad>> of an answer: one for each function line that has a file, inside the row.

    Lines in order: a blank line or a file line (``.py`` at the end, before anything else) ends the class; ``class:`` sets
    it; ``function:`` or ``method:`` emits. A dotted name carries its own class. `bad` marks function lines without a name.
    """
    return F.transform(_function_lines(answer), _location)


def locations(answers: DataFrame, id_col: str = "traj_id", text_col: str = "answer") -> DataFrame:
    """traj_id, pos, file, class, function, bad: a row for each location of an answer, numbered in its order."""
    rows = answers.select(F.col(id_col).alias("traj_id"), F.posexplode(_function_lines(F.col(text_col))).alias("pos", "_line"))
    w = F.split("_line", "\n")
    rest = lambda i: F.substring(F.get(w, F.lit(i)), 2, 1 << 30)
    rows = rows.select("traj_id", "pos", rest(1).alias("file"), F.when(F.get(w, F.lit(2)).startswith(" "), rest(2)).alias("_context"), rest(3).alias("_said"))
    rows = rows.withColumn("_name", called(F.col("_said")))
    return rows.select("traj_id", "pos", *named(F.col("file"), F.col("_context"), F.col("_said"), F.col("_name")))


def answer_lines(answers: DataFrame, id_col: str = "traj_id", text_col: str = "answer") -> DataFrame:
    """traj_id, pos, line: an answer as a long table of trimmed lines."""
    lines = F.transform(F.split(answer_body(F.col(text_col)), "\n"), strip)
    return answers.select(F.col(id_col).alias("traj_id"), F.posexplode(lines).alias("pos", "line"))


def locations_of_lines(lines: DataFrame, range_rows: int = RANGE_ROWS, parts: int | None = None) -> DataFrame:
    """traj_id, pos (of the line), file, class, function, bad: `location_list` over a long table of trimmed lines.

    For answers that no row should hold whole: file and class are carried forward, and a blank or file line carries no class on.
    """
    does = role(F.col("line"))
    file = F.when(does == "F", F.col("line"))
    context = F.when(does.isin("B", "F"), F.struct(F.lit(None).cast("string").alias("name"))).when(does == "C", F.struct(after_colon(F.col("line")).alias("name")))
    known = carried(lines.where(does.isNotNull()), "traj_id", "pos", {"in": file, "context": context}, range_rows, parts)
    rows = known.where((role(F.col("line")) == "M") & F.col("in").isNotNull())
    return rows.select("traj_id", "pos", location(F.col("in"), F.col("context.name"), after_colon(F.col("line"))).alias("l")).select("traj_id", "pos", "l.*")


def entity(file: Column, class_: Column, function: Column) -> Column:
    """``file:Class.function`` or ``file:function``, without a constructor at the end."""
    name = F.when(F.coalesce(class_, F.lit("")) != "", F.concat(class_, F.lit("."), function)).otherwise(function)
    return F.regexp_replace(F.concat(file, F.lit(":"), name), r"\.__init__$", "")


def module(entity_: Column) -> Column:
    """The entity up to its last dot after the last colon; itself without one."""
    return F.when(F.substring_index(entity_, ":", -1).contains("."), F.regexp_replace(entity_, r"\.[^.]*$", "")).otherwise(entity_)


def answer_sets(answers: DataFrame, id_col: str = "traj_id", text_col: str = "answer") -> DataFrame:
    """traj_id, files, modules, entities: distinct and sorted; empty for answers without a location. A row per answer.

    An answer with a nameless function line can't be parsed: its sets are null, and rewards on them fail.
    """
    rows = answers.select(F.col(id_col).alias("traj_id"), location_list(F.col(text_col)).alias("found"))
    files = F.transform("found", lambda l: l["file"])  # noqa: E741
    entities = F.transform("found", lambda l: entity(l["file"], l["class"], l["function"]))  # noqa: E741
    rows = rows.select("traj_id", files.alias("files"), entities.alias("entities"), F.exists("found", lambda l: l["bad"]).alias("bad"))  # noqa: E741
    set_of = lambda c: F.when(~F.col("bad"), F.array_sort(F.array_distinct(c)))
    return rows.select("traj_id", set_of(F.col("files")).alias("files"), set_of(F.transform("entities", module)).alias("modules"), set_of(F.col("entities")).alias("entities"))


def tagged_files(text: Column) -> Column:
    """Paths of the ``<files>`` block, normalised: a JSON list, or lines; null without a block, empty for broken JSON."""
    tag = r"(?s)<files>(.*?)</files>"
    payload = strip(F.regexp_extract(text, tag, 1))
    listed = F.coalesce(F.from_json(payload, "array<string>"), F.array().cast("array<string>"))
    lines = F.filter(F.transform(F.split(payload, "\n"), strip), lambda line: line != "")
    return F.when(text.rlike(tag), F.transform(F.when(payload.startswith("["), listed).otherwise(lines), normalize_path))
