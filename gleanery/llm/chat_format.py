"""Chat formatting by perspective rotation: a dialogue is rendered once for each of its participants.

In a rendering, that participant's turns are the assistant's and the others are named users; the
mask marks the assistant's words. Turns are numbered by one range sort over all conversations, so a
conversation with very many turns, or with very many of one number, is dealt over many tasks. A rendering
comes in chunks of turns that follow each other without a seam; each says where in the rendering it begins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import BROADCAST_ROWS, written

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Turns of a chunk, and chunks of a stretch whose lengths are summed up first.
CHUNK, STRETCH = 256, 4_096


def escaped(text: Column) -> Column:
    r"""``text`` without the strings of the markers: ``<|`` is written ``<\|``, ``<\|`` is ``<\\|``, and so on,
    so that taking one backslash from each gives the text again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def _header(role: Column, own: Column) -> Column:
    return F.concat(F.lit(OPEN), F.when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user "), role)), F.lit("\n"))


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text, numbered) with ``rank``, a row's place in its conversation from 0; rows with a number that are
    equal to the one before are left out. Each task numbers one range of the sorted rows; only conversations that go on from one range
    to the next are put together by counts, and of those there are no more than ranges."""
    order = ["conv", "turn", "role", "text", "numbered"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*rows.schema.fields, T.StructField("inside", T.LongType()), T.StructField("part", T.IntegerType())])

    def numbered(batches):
        from pyspark import TaskContext

        part, last, conv, n = TaskContext.get().partitionId(), None, None, -1
        for b in batches:
            keep, at = [], []
            keys = [b.column(i).to_pylist() for i in (0, 1, 2, 4)]
            for i, key in enumerate(zip(*keys)):
                here = (key, b.column(3)[i].as_py())
                if key[3] and here == last:
                    continue
                n = n + 1 if last is not None and key[0] == conv else 0
                conv, last = key[0], here
                keep.append(i)
                at.append(n)
            took = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(at, pa.int64()), pa.array([part] * len(at), pa.int32())], names=schema.names)

    placed = written(dealt.mapInArrow(numbered, schema), "turns")
    counts = placed.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = "partition by conv order by part rows between unbounded preceding and 1 preceding"
    starts = counts.select(F.col("conv").alias("of"), F.col("part").alias("at"), F.expr(f"coalesce(sum(n) over ({before}), 0L)").alias("base")).where("base > 0")
    starts = written(starts, "starts")
    few = starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = F.col("conv").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at"))
    return placed.join(F.broadcast(starts) if few else starts, same, "left").select(
        "conv", "turn", "role", "text", (F.coalesce("base", F.lit(0).cast("long")) + F.col("inside")).alias("rank")
    )


def rotate(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """``conv_col``, ``participant``, ``chunk``, ``offset``, ``text``, ``mask`` (spans of characters), ``n_turns``, ``n_own``.

    A rendering is the texts of its chunks in order; ``offset`` is where the chunk begins in it, mask
    spans count from there. Turns go by number, those of one number by role and text; a null number counts as 0, a null
    role as "unknown", a null text as empty. Rows with a number that are equal in all four are one
    turn, rows without a number are a turn each. A null conversation is one like any other. Texts may be of any
    length; markers in texts and roles are escaped, and line ends in roles are blanks, so no text can speak for
    another participant. A participant named "assistant" is "user assistant" to the others. In a chunk in which a participant is silent the mask is
    empty. An empty table gives none; other columns are not read, whatever their names.
    """
    number = F.col(f"`{turn_col}`").cast("long")
    raw = turns.select(
        F.col(f"`{conv_col}`").alias("conv"), F.coalesce(number, F.lit(0).cast("long")).alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), number.isNotNull().alias("numbered"),
    )
    rows = _ranked(raw).select(
        "conv", F.floor(F.col("rank") / chunk).alias("chunk"), "rank", F.translate(escaped(F.col("role")), "\r\n", "  ").alias("name"), "role", escaped(F.col("text")).alias("text")
    )
    chunks = rows.groupBy("conv", "chunk").agg(F.array_sort(F.collect_list(F.struct("rank", "role", "name", "text"))).alias("turns"))
    said = rows.groupBy("conv", "chunk", "role").agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("name"), F.sum(F.char_length("text")).alias("chars"))
    people = said.groupBy(F.col("conv").alias("of"), F.col("role").alias("participant")).agg(F.max("name").alias("called")).select("of", "participant", "called")
    each = chunks.join(people, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    starts = written(_offsets(said, people), "offsets")
    few = starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = lambda t: t["role"] == F.col("participant")
    parts = each.withColumns({
        "heads": F.transform("turns", lambda t: _header(t["name"], own(t))),
        "bodies": F.transform("turns", lambda t: F.concat(t["text"], F.lit(CLOSE))),
    })
    sized = parts.withColumn("lens", F.zip_with("heads", "bodies", lambda h, b: F.char_length(h) + F.char_length(b)))
    start = F.transform("lens", lambda _, i: F.aggregate(F.slice("lens", 1, i), F.lit(0), lambda a, x: a + x))
    spans = F.transform(
        "turns",
        lambda t, i: F.struct(
            own(t).alias("own"),
            (F.get("start", i) + F.char_length(F.get("heads", i))).cast("long").alias("start"),
            F.char_length(F.get("bodies", i)).cast("long").alias("length"),
        ),
    )
    mask = F.transform(F.filter(spans, lambda s: s["own"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    same = F.col("conv").eqNullSafe(F.col("at_conv")) & (F.col("participant") == F.col("at_participant")) & (F.col("chunk") == F.col("at_chunk"))
    made = sized.withColumn("start", start).join(F.broadcast(starts) if few else starts, same, "left")
    return made.select(
        F.col("conv").alias(conv_col), "participant", "chunk", F.coalesce("begins", F.lit(0).cast("long")).alias("offset"),
        F.array_join(F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b)), "").alias("text"),
        mask.alias("mask"), F.size("turns").cast("long").alias("n_turns"), F.size(mask).cast("long").alias("n_own"),
    )


def _offsets(said: DataFrame, people: DataFrame) -> DataFrame:
    """Where each chunk but the first begins in each participant's rendering, from sums of lengths alone; stretches of
    chunks are summed up first, so no task holds all chunks of a long conversation."""
    plain = F.lit(len(OPEN) + len("user ") + 1 + len(CLOSE)) + F.char_length("name")
    base = said.groupBy("conv", "chunk").agg(F.sum(F.col("n") * plain + F.col("chars")).alias("chars"), F.max("chunk").alias("c"))
    long_ = base.groupBy(F.col("conv").alias("l")).agg(F.max("chunk").alias("most")).where("most > 0").select("l")
    own = said.select(F.col("conv").alias("oc"), F.col("chunk").alias("ok"), F.col("role").alias("op"), (F.col("n") * (F.lit(len("assistant")) - F.lit(len("user ")) - F.char_length("name"))).alias("more"))
    many = base.join(long_, F.col("conv").eqNullSafe(F.col("l")), "left_semi").join(people, F.col("conv").eqNullSafe(F.col("of")))
    same = F.col("conv").eqNullSafe(F.col("oc")) & (F.col("chunk") == F.col("ok")) & (F.col("participant") == F.col("op"))
    each = many.join(own, same, "left").select(
        "conv", "participant", "chunk", F.floor(F.col("chunk") / STRETCH).alias("stretch"), (F.col("chars") + F.coalesce("more", F.lit(0))).alias("chars")
    )
    up = "rows between unbounded preceding and 1 preceding"
    whole = each.groupBy("conv", "participant", "stretch").agg(F.sum("chars").alias("chars"))
    whole = whole.select(
        F.col("conv").alias("wc"), F.col("participant").alias("wp"), F.col("stretch").alias("ws"),
        F.expr(f"coalesce(sum(chars) over (partition by conv, participant order by stretch {up}), 0L)").alias("low"),
    )
    inside = each.withColumn("into", F.expr(f"coalesce(sum(chars) over (partition by conv, participant, stretch order by chunk {up}), 0L)"))
    at = F.col("conv").eqNullSafe(F.col("wc")) & (F.col("participant") == F.col("wp")) & (F.col("stretch") == F.col("ws"))
    return inside.join(whole, at).where("chunk > 0").select(
        F.col("conv").alias("at_conv"), F.col("participant").alias("at_participant"), F.col("chunk").alias("at_chunk"), (F.col("low") + F.col("into")).alias("begins")
    )
