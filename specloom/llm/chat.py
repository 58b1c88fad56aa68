"""Multi-party perspective rotation of conversations, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as assistant and all others as
named users; the mask covers what the assistant says. A dialogue is rendered in parts of PART turn numbers. Where so
many messages share few numbers that a part would hold more than MOST of them, each number is a piece of its own, and
a number of more than MOST messages is dealt over pieces by a hash, its repeated messages counted first. So no row is
unbounded, and a conversation that holds a third of all rows is dealt over many tasks: parts are numbered before they are
gathered, and meet the conversation's speakers in as many tasks as they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import observed, spread_join

PART = 256
#: Messages of a row; a piece by hash holds MOST / 4 of them on average.
MOST = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Roles that speak in no one's name: they open no perspective and keep their own header.
STAGE = ("system",)


def _safe(text: Column) -> Column:
    """Markers inside texts are broken up, so that no turn can pose as another."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _pieces(turns: DataFrame, part: int, most: int) -> DataFrame:
    """turns (c, turn, role, text, part) with piece and n, how often a message stands there."""
    whole = turns.select("*", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("n"))
    sizes, seen = observed(turns.groupBy("c", "part").agg(F.count("*").alias("cnt")).where(F.col("cnt") > most), "overfull", total=F.sum("cnt"), top=F.max("cnt"))
    if not seen["top"]:
        return whole
    # few parts are overfull: their keys, which may be null, meet all turns under names that are never null
    key = [F.coalesce(F.col("c").cast("string"), F.lit("")).alias("_c_"), F.col("c").isNull().alias("_n_")]
    over = sizes.select(*key, F.col("part").alias("_p_"), F.col("cnt").alias("_cnt_"))
    met = turns.select("*", *key, F.col("part").alias("_p_")).join(over, ["_c_", "_n_", "_p_"], "left")
    fits = met.where("_cnt_ IS NULL").select(whole.columns[:-2]).select("*", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("n"))
    # equal messages of a number first become one row a task, then one, then rows of bounded multiplicity
    each = met.where("_cnt_ IS NOT NULL").groupBy("c", "part", "turn", "role", "text").agg(F.count("*").alias("m"))
    step = max(1, most // 4)
    each = each.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / step))))
    each = each.withColumn("n", F.least(F.lit(step).cast("long"), F.col("m") - F.col("i") * step))
    numbers = each.groupBy("c", "part", "turn").agg(F.sum("n").alias("t"))
    each = each.join(numbers.withColumnRenamed("part", "part2").select(F.col("c").alias("c2"), "part2", F.col("turn").alias("turn2"), "t"), F.col("c").eqNullSafe(F.col("c2")) & (F.col("part") == F.col("part2")) & F.col("turn").eqNullSafe(F.col("turn2")))
    pieces = F.ceil(F.col("t") / step).cast("long")
    dealt = F.when(F.col("t") > most, F.pmod(F.pmod(F.xxhash64("role", "text"), pieces) + F.col("i"), pieces)).otherwise(F.lit(0))
    number = F.when(F.col("turn").isNull(), F.lit(1)).otherwise(F.pmod("turn", F.lit(part)) + 2)
    each = each.withColumn("piece", (number.cast("long") * F.lit(1 << 40)) + dealt.cast("long"))
    return fits.unionByName(each.select("c", "turn", "role", "text", "part", "piece", "n"))


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART, most: int = MOST) -> DataFrame:
    """Per conversation, participant, part and piece: conv_id, perspective, part, piece (0: the whole part), n_turns, rendered, mask (spans of the assistant's texts and their end markers, in code points of rendered).

    Turns are ordered by turn (null first, in part 0), then role, then text; repeated turns stay, each of them. A null
    role is the participant "unknown", a null text is empty. A conversation of stage roles alone has no perspective,
    hence no row; empty tables give none. A null conv_id is a conversation like any other. A part of more than `most`
    turns has a piece for each turn number, and several for a number of more than `most` turns.
    """
    turns = conversations.select(
        F.col(conv_col).alias("c"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("part", F.floor(F.coalesce("turn", F.lit(0)) / part).cast("long"))
    turns = _pieces(turns, part, most)
    key = [F.coalesce(F.col("c").cast("string"), F.lit("")).alias("_c_"), F.col("c").isNull().alias("_n_")]
    n_parts, seen = observed(turns.select(*key, "part", "piece").distinct().groupBy("_c_", "_n_").agg(F.count("*").alias("parts")), "parts", total=F.sum("parts"))
    speakers = turns.where(~F.col("role").isin(*STAGE)).select(*key, F.col("role").alias("perspective")).distinct().join(n_parts, ["_c_", "_n_"])
    blocks = turns.groupBy("c", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "n"))).alias("msgs"))
    blocks = blocks.withColumn("msgs", F.when(F.col("piece") == 0, F.col("msgs")).otherwise(F.flatten(F.transform("msgs", lambda m: F.array_repeat(m, m["n"].cast("int"))))))
    rows = spread_join(blocks.select("*", *key), speakers, ["_c_", "_n_"], "parts", F.xxhash64("part", "piece"), seen["total"] or 0)

    def header(m: Column) -> Column:
        name = _safe(F.regexp_replace(m["role"], "[\\n\\r]", " "))
        return F.concat(F.lit(OPEN), F.when(m["role"].isin(*STAGE), name).when(m["role"] == F.col("perspective"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name)), F.lit("\n"))

    segs = F.transform("msgs", lambda m: F.struct(header(m).alias("h"), F.concat(_safe(m["text"]), F.lit(CLOSE)).alias("b"), (m["role"] == F.col("perspective")).alias("own")))
    rows = rows.select("c", "perspective", "part", "piece", segs.alias("segs"))
    start = F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>))")

    def step(acc: Column, s: Column) -> Column:
        at = acc["at"] + F.length(s["h"])
        end = at + F.length(s["b"])
        return F.struct(end.alias("at"), F.when(s["own"], F.concat(acc["spans"], F.array(F.struct(at.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    return rows.select(
        F.col("c").alias(conv_col),
        "perspective",
        "part",
        "piece",
        F.size("segs").cast("long").alias("n_turns"),
        F.array_join(F.transform("segs", lambda s: F.concat(s["h"], s["b"])), "").alias("rendered"),
        F.aggregate("segs", start, step, lambda a: a["spans"]).alias("mask"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select(
        "conv_id",
        "perspective",
        "part",
        "piece",
        "n_turns",
        F.length("rendered").cast("long").alias("n_chars"),
        F.aggregate("mask", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_masked"),
        F.sha2("rendered", 256).alias("rendered_sha256"),
        F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("mask"),
    )


SQL = r"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, CAST(floor(coalesce(turn, 0) / 256) AS BIGINT) AS part FROM conversations),
s AS (SELECT DISTINCT c, role AS perspective FROM t WHERE role <> 'system'),
r AS (SELECT t.c, s.perspective, t.part, t.turn, t.role, t.text, t.role = s.perspective AS own,
  '<|im_start|>' || CASE WHEN t.role = 'system' THEN t.role WHEN t.role = s.perspective THEN 'assistant' ELSE 'user name=' || replace(regexp_replace(t.role, '[\n\r]', ' ', 'g'), '<|', '< |') END || chr(10) AS h,
  replace(t.text, '<|', '< |') || '<|im_end|>' || chr(10) AS b FROM t JOIN s ON t.c IS NOT DISTINCT FROM s.c),
o AS (SELECT *, row_number() OVER w AS n, sum(length(h) + length(b)) OVER (PARTITION BY c, perspective, part ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM r WINDOW w AS (PARTITION BY c, perspective, part ORDER BY turn NULLS FIRST, role, text))
SELECT c AS conv_id, perspective, part, CAST(0 AS BIGINT) AS piece, count(*) AS n_turns, CAST(sum(length(h) + length(b)) AS BIGINT) AS n_chars,
  CAST(sum(CASE WHEN own THEN length(b) ELSE 0 END) AS BIGINT) AS n_masked, sha256(string_agg(h || b, '' ORDER BY n)) AS rendered_sha256,
  coalesce(string_agg(CAST(CAST(upto - length(b) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(upto AS BIGINT) AS VARCHAR), ',' ORDER BY n) FILTER (WHERE own), '') AS mask
FROM o GROUP BY 1, 2, 3
"""
