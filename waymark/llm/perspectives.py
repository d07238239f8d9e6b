"""Multi-party perspective rotation: each participant's view of a dialogue, as chat text with a training mask.

For every participant (every speaker but the system) the dialogue is rendered once, with that speaker as assistant,
the others as users under their names, and the system's turns as they are. The mask marks the assistant's words: `spans`
gives their character ranges as "start-end,start-end", `turn_mask` a 1 or 0 for each turn.

DataFrame functions only. A view's row is a part of it: its turns from PART_TURNS * part on, PART_TURNS of them or what is left,
whatever their turn numbers are, so that no row holds an unbounded conversation; offsets run on over the parts. That is the result for
dialogues of every length. Where all turns fit one part no places are needed to know it; of the others, places in ranges of
their order are counted.

Null role: the speaker `unknown`. Null text: empty. Null turn: before the others, negative ones included. Null conversation
ids form one conversation. Repeated rows are repeated turns. Ties in turn are ordered by speaker, then text. A conversation of
system turns alone has no participant and no row. Markers can't be forged: inside a text `<|` becomes `< |`, and in a name
`<`, `|`, `>` and line breaks become `_` (in the text only; `speaker` is the name as it is). Very long texts are whole.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

PART_TURNS = 1024
SYSTEM = "system"
KEYS = ["conv_id", "speaker", "part"]


def speakers(said: DataFrame) -> DataFrame:
    return said.where(F.col("by") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("by").alias("speaker")).distinct()


def in_parts(said: DataFrame, part_turns: int) -> DataFrame:
    """said with `part`, by places in (turn, by, body) counted over ranges of the order; equal turns are one row until they have their places."""
    order = ["turn", "by", "body"]
    counted = said.groupBy("conv_id", *order).agg(F.count("*").alias("n"))
    ranged = counted.repartitionByRange(shared.shuffle_partitions(said.sparkSession), "conv_id", *order).withColumn("cell", F.spark_partition_id())
    ranged = shared.stage(ranged, "dialogue-ranges")  # ranges are drawn from a sample: they must not be drawn again
    before = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    cells = ranged.groupBy("conv_id", "cell").agg(F.sum("n").alias("m")).select(F.col("conv_id").alias("of"), F.col("cell").alias("of_cell"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    placed = placed.join(cells, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("of_cell")))
    placed = placed.select("conv_id", *order, (F.col("before") + F.col("inside")).alias("start"), (F.col("before") + F.col("inside") + F.col("n")).alias("end"))
    placed = placed.withColumn("part", F.explode(F.sequence(F.floor(F.col("start") / part_turns), F.floor((F.col("end") - 1) / part_turns))))
    copies = F.least("end", (F.col("part") + 1) * part_turns) - F.greatest("start", F.col("part") * part_turns)
    return placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select("conv_id", *order, "part")


def views(said: DataFrame, speakers_: DataFrame, same: Column) -> DataFrame:
    """conv_id, speaker, part, n_turns, n_chars, turns: a row per part of a view."""
    seen = said.join(speakers_, same)
    own = F.col("by") == F.col("speaker")
    head = F.when(F.col("by") == SYSTEM, "<|system|>\n").when(own, "<|assistant|>\n").otherwise(F.concat(F.lit("<|user name="), F.translate("by", "<|>\n\r", "_____"), F.lit("|>\n")))
    seen = seen.select(
        *KEYS,
        F.struct("turn", "by", "body").alias("place"),
        own.cast("int").alias("own"),
        F.length(head).alias("n_head"),
        F.length("body").alias("n_body"),
        F.concat(head, "body", F.lit("<|end|>\n")).alias("segment"),
    )
    before = Window.partitionBy(*KEYS).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumn("at", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)))
    one = F.struct("place", "segment", "own", (F.col("at") + F.col("n_head")).alias("start"), (F.col("at") + F.col("n_head") + F.col("n_body")).alias("end"))
    return placed.groupBy(*KEYS).agg(F.count("*").alias("n_turns"), F.sum(F.length("segment")).alias("n_chars"), F.array_sort(F.collect_list(one)).alias("turns"))


def rendered(parts: DataFrame) -> DataFrame:
    """Parts, with the characters before each as `base`, as text."""
    span = lambda t: F.concat((t["start"] + F.col("base")).cast("string"), F.lit("-"), (t["end"] + F.col("base")).cast("string"))
    return parts.select(
        *KEYS,
        "n_turns",
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("text"),
        F.array_join(F.transform("turns", lambda t: t["own"].cast("string")), "").alias("turn_mask"),
        F.array_join(F.transform(F.filter("turns", lambda t: t["own"] == 1), span), ",").alias("spans"),
    )


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part, n_turns, text, turn_mask, spans."""
    said = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("by"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"),
    )
    of, zero = F.col("conv_id").eqNullSafe(F.col("of")), F.lit(0).cast("long")
    sizes = said.groupBy(F.col("conv_id").alias("of")).agg(F.count("*").alias("n"))
    long_ = shared.stage(sizes.where(F.col("n") > part_turns), "long-dialogues")
    some = long_.limit(1).count() > 0
    usual = said.join(shared.checked_broadcast(long_), of, "left_anti") if some else said
    whole = rendered(views(usual.withColumn("part", zero), speakers(usual), of).withColumn("base", zero))
    if not some:
        return whole
    dealt = shared.stage(in_parts(said.join(shared.checked_broadcast(long_), of, "left_semi"), part_turns), "dialogue-parts")
    last = dealt.groupBy("conv_id").agg(F.max("part").alias("last"))
    each = speakers(dealt).join(last, of).select("of", "speaker", F.explode(F.sequence(zero, "last")).alias("of_part"))
    parts = shared.stage(views(dealt, each, of & (F.col("part") == F.col("of_part"))), "long-views")
    earlier = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part, without its texts
    bases = parts.select(F.col("conv_id").alias("of"), F.col("speaker").alias("whose"), F.col("part").alias("of_part"), F.coalesce(F.sum("n_chars").over(earlier), F.lit(0)).alias("base"))
    return whole.unionByName(rendered(parts.join(bases, of & (F.col("speaker") == F.col("whose")) & (F.col("part") == F.col("of_part")))))


#: The same in SQL, for dialogues of any length.
SQL = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS sp, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations
), dealt AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sp, body) - 1) // {PART_TURNS} AS part FROM said
), speakers AS (
  SELECT DISTINCT conv_id, sp AS speaker FROM said WHERE sp <> 'system'
), views AS (
  SELECT s.conv_id, p.speaker, s.part, s.turn, s.sp, s.body, s.sp = p.speaker AS own,
         CASE WHEN s.sp = 'system' THEN '<|system|>' WHEN s.sp = p.speaker THEN '<|assistant|>' ELSE '<|user name=' || translate(s.sp, '<|>' || chr(10) || chr(13), '_____') || '|>' END || chr(10) AS head
  FROM dealt s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, head || body || '<|end|>' || chr(10) AS segment,
         coalesce(sum(length(head) + length(body) + 8) OVER (PARTITION BY conv_id, speaker ORDER BY part, turn NULLS FIRST, sp, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM views
)
SELECT conv_id, speaker, part::BIGINT AS part, count(*) AS n_turns,
       string_agg(segment, '' ORDER BY turn NULLS FIRST, sp, body, pos) AS text,
       string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' ORDER BY turn NULLS FIRST, sp, body, pos) AS turn_mask,
       coalesce(string_agg(CASE WHEN own THEN (pos + length(head))::BIGINT::VARCHAR || '-' || (pos + length(head) + length(body))::BIGINT::VARCHAR END, ',' ORDER BY turn NULLS FIRST, sp, body, pos), '') AS spans
FROM placed GROUP BY conv_id, speaker, part
"""
