"""Chat formatting with prefix-target expansion.

Every turn becomes one segment ``<turn role>text</turn>\\n`` in which control characters of role and text are escaped
with a backslash, so a text can hold any marker and still be read back. The segments of a conversation in order are
one stream. Every assistant turn is exploded into an example of its own: all turns before it are its context, only its
reply is trainable. That context is always the stream's prefix, so an example's row (:func:`examples`) states it by its
length and holds its own last segment with the span of the loss mask in the example's text: linear in the input, while
:func:`render` writes whole texts, whose size grows with the square of a conversation's turns. :func:`read_back` takes
formatted turns and examples apart again: turns from the stream, the loss from the examples.

Order: by turn (null first); equal turns by role, then text, ties beyond that are equal rows. Cases: a null text or role
is an empty one; a null conv_id is a conversation; repeated rows are turns of their own; a conversation without an
assistant has no example and an empty loss mask; empty texts stay turns; texts of any length are one segment; further
columns are ignored; an empty table gives no rows (the query: its probe). A conversation is numbered and read back in one
task, as a stream that is sorted on disk where it must be: a digest of a sequence can't be split.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

OPEN, CLOSE = "<turn ", "</turn>\n"
TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.S)
TRAINED = "assistant"


def escaped(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\<>])", r"\\$1")


def unescaped(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def formatted(conversations: DataFrame) -> DataFrame:
    """A row a turn: conv_id, seq, segment, its first and last place in the stream, and the loss span in the segment."""
    c = conversations.select("conv_id", "turn", *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text")])
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(">"))
    c = c.withColumn("_head", head).withColumn("_body", escaped(F.col("text"))).withColumn("segment", F.concat("_head", "_body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("seq", F.sum(F.lit(1)).over(order)).withColumn("end", F.sum(F.length("segment")).over(order))
    trained = F.col("role") == TRAINED
    return c.select(
        "conv_id", "seq", "segment", (F.col("end") - F.length("segment")).alias("start"), "end",
        F.when(trained, F.length("_head")).alias("loss_start"), F.when(trained, F.length("_head") + F.length("_body")).alias("loss_end"),
    )


def examples(turns: DataFrame) -> DataFrame:
    """An example an assistant turn: conv_id, seq, n_context (turns before it), context (characters of the stream before
    it), segment (its last), and the only trainable span [loss_start, loss_end) of the whole text."""
    return turns.where("loss_start is not null").select(
        "conv_id", "seq", (F.col("seq") - 1).alias("n_context"), F.col("start").alias("context"), "segment",
        (F.col("start") + F.col("loss_start")).alias("loss_start"), (F.col("start") + F.col("loss_end")).alias("loss_end"))


def expanded(turns: DataFrame) -> DataFrame:
    """The rows of turns, each followed by its example if it is an assistant's: a row a turn with n_context null, and a row
    an example with all columns of :func:`examples`."""
    none = F.lit(None).cast("long")
    plain = F.struct(none.alias("n_context"), none.alias("context"), F.col("segment").alias("segment"), none.alias("loss_start"), none.alias("loss_end"))
    target = F.struct((F.col("seq") - 1).cast("long").alias("n_context"), F.col("start").cast("long").alias("context"), F.col("segment").alias("segment"), (F.col("start") + F.col("loss_start")).cast("long").alias("loss_start"), (F.col("start") + F.col("loss_end")).cast("long").alias("loss_end"))
    rows = F.when(F.col("loss_start").isNull(), F.array(plain)).otherwise(F.array(plain, target))
    return turns.select("conv_id", "seq", F.explode(rows).alias("_x")).select("conv_id", "seq", "_x.*")


def render(turns: DataFrame) -> DataFrame:
    """Examples with their texts written out. A conversation of n turns has texts of n * n / 2 segments in all."""
    stream = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "segment"))), lambda x: x["segment"]), "").alias("_s"))
    e = examples(turns).alias("e").join(stream.alias("s"), F.col("e.conv_id").eqNullSafe(F.col("s.conv_id")))
    return e.select("e.conv_id", "n_context", F.concat(F.substring(F.col("_s"), F.lit(1), F.col("context").cast("int")), "segment").alias("text"), "loss_start", "loss_end")


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long"


def read_back(batches):
    """Digests of conversations from rows of :func:`expanded` in the order of (conv_id, seq, n_context): turns from the
    stream, the loss from the examples. An example that doesn't fit the stream before it is an error. A conversation
    may span batches."""
    import pyarrow as pa

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")]
    done: list[list] = []
    last, started = None, False
    n = shown = loss_chars = chars = n_examples = example_chars = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        done.clear()
        return out

    row = lambda: [last, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_examples, example_chars]
    for batch in batches:
        cols = (batch.column(x).to_pylist() for x in ("conv_id", "n_context", "context", "segment", "loss_start", "loss_end"))
        for conv, n_context, context, segment, a, b in zip(*cols, strict=True):
            if not started or conv != last:
                if started:
                    done.append(row())
                last, started = conv, True
                n = shown = loss_chars = chars = n_examples = example_chars = 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            if n_context is None:
                shown = chars
                for role, text in TURN.findall(segment):
                    n += 1
                    turns.update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
                chars += len(segment)
                continue
            if context != shown or n_context != n - 1 or not 0 <= a - context <= b - context <= len(segment):
                raise ValueError(f"an example of conversation {conv} doesn't follow its context")
            reply = unescaped(segment[a - context : b - context])
            loss.update(reply.encode())
            loss_chars += len(reply)
            n_examples += 1
            example_chars += context + len(segment)
        if done:
            yield flush()
    if started:
        done.append(row())
        yield flush()


PROBE = r"\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, each assistant turn exploded into its example, and both read back.

    Cases: see the module; the probe conversation -7 is always there; null and equal turns have a fixed order; a text of
    any length is one segment; further columns are ignored.
    """
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"))
    probe = probe.select("conv_id", "turn", F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = expanded(formatted(c.unionByName(probe))).repartition("conv_id").sortWithinPartitions("conv_id", "seq", F.col("n_context").asc_nulls_first())
    return rows.select("conv_id", "n_context", "context", "segment", "loss_start", "loss_end").mapInArrow(read_back, SCHEMA)


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, 15 + length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')) AS n FROM c),
o AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM s)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars, (count(*) FILTER (role = 'assistant'))::BIGINT AS n_examples,
  coalesce(sum(upto) FILTER (role = 'assistant'), 0)::BIGINT AS example_chars
FROM o GROUP BY conv_id
"""
