"""Chat formatting of conversations with a loss mask. DataFrame functions only.

The turns of a conversation are collected as structs and sorted by turn, role and text. Neighbours of the same role are
merged into one message by array functions; a message is ``<|im_start|>role``, a line feed, its texts with ``<|im_sep|>`` between
them, ``<|im_end|>`` and a line feed. The loss mask is a list of spans (start and length in code points of the formatted
string) that cover the texts of the trained roles and nothing else.

Texts may hold control strings themselves: a backslash is put between ``<`` and ``|`` (one more where there are some already), so
that no text holds ``<|``, and taken out again on reading; roles also have their line feeds escaped. ``read_turns`` and
``read_trained`` get turns and trained texts back from the formatted string and the mask alone.

Work per conversation is linear in its turns and characters: places are summed in two levels of arrays, and spans are cut out of
the fixed-width form of the string. A conversation is one row by its nature, so the largest one must fit into a task.

Edge cases: a null text or role is empty; equal rows and equal turn numbers stay, in the stated order, null turns first; rows without a
conversation id are left out, as they belong to none; an empty table gives an empty result; columns other than the four named
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED = ("assistant",)
_PART = 256


def escaped(text: Column) -> Column:
    """``text`` without ``<|``; ``unescaped`` gives it back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")), F.lit("<|"), F.lit("<\\p"))


def _unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("<\\p"), F.lit("<|")), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _running(sizes: str) -> Column:
    """The sum of the numbers before each place of the array column ``sizes``, in parts, so that no long array grows by copies."""
    zero = F.array(F.lit(0)).cast("array<long>")
    appended = lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _PART).cast("int")), lambda k: F.slice(sizes, k * _PART + 1, F.lit(_PART)))
    sums = F.transform(parts, lambda part: F.aggregate(part, zero, appended))
    bases = F.aggregate(sums, zero, lambda out, s: appended(out, F.element_at(s, -1)))
    placed = F.zip_with(sums, F.slice(bases, F.lit(1), F.size(bases) - 1), lambda s, base: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda x: x + base))
    return F.flatten(placed)


def formatted(
    rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", trained: tuple[str, ...] = TRAINED
) -> DataFrame:
    """``(conv_id, formatted, loss_spans array<struct<start long, length long>>)`` per conversation."""
    known = rows.where(F.col(id_column).isNotNull())
    turn = F.struct(F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    chats = known.select(F.col(id_column).alias("conv_id"), turn.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    # The places where a message begins, and one place behind the last turn.
    role = lambda i: F.get("turns", i)["role"]
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    chats = chats.withColumn("begins", F.concat(begins, F.array(F.size("turns"))))
    message = lambda k: F.slice("turns", F.get("begins", k) + 1, F.get("begins", k + 1) - F.get("begins", k))
    messages = F.transform(F.sequence(F.lit(0), F.size("begins") - 2), message)
    pieces = lambda m: F.transform(
        m,
        lambda t, i: F.struct(
            F.when(i == 0, F.concat(F.lit(START), _escaped_role(t["role"]), F.lit("\n"))).otherwise(F.lit(SEP)).alias("before"),
            escaped(t["text"]).alias("body"),
            F.when(i == F.size(m) - 1, F.lit(END + "\n")).otherwise(F.lit("")).alias("after"),
            t["role"].isin(*trained).alias("trained"),
        ),
    )
    chats = chats.select("conv_id", messages.alias("messages")).select("conv_id", F.flatten(F.transform("messages", pieces)).alias("pieces"))
    chats = chats.select("conv_id", "pieces", F.transform("pieces", lambda p: F.length(F.concat(p["before"], p["body"], p["after"])).cast("long")).alias("sizes"))
    chats = chats.select("conv_id", "pieces", _running("sizes").alias("places"))
    span = lambda p, at: F.struct((at + F.length(p["before"])).alias("start"), F.length(p["body"]).cast("long").alias("length"), p["trained"].alias("trained"))
    spans = F.transform(F.filter(F.zip_with("pieces", "places", span), lambda s: s["trained"]), lambda s: F.struct(s["start"], s["length"]))
    return chats.select("conv_id", F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["body"], p["after"])), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` of a formatted string."""
    messages = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda m, i: i > 0)
    role = lambda m: F.substring_index(m, "\n", 1)
    body = lambda m: m.substr(F.length(role(m)) + 2, F.length(m) - F.length(role(m)) - len(END) - 2)
    turns = lambda m: F.transform(F.split(body(m), r"<\|im_sep\|>"), lambda t: F.struct(_unescaped_role(role(m)).alias("role"), unescaped(t).alias("text")))
    return F.flatten(F.transform(messages, turns))


def read_trained(chats: DataFrame) -> DataFrame:
    """``chats`` of ``formatted`` with ``trained``, the texts under the loss mask in order, unescaped."""
    # Four bytes a character: spans are cut out at their place. The sign before a span keeps a text's first from being a byte order mark.
    wide = chats.withColumn("__wide", F.encode("formatted", "UTF-32"))
    cut = lambda s: F.decode(F.substring("__wide", 4 * s["start"] - 3, 4 * s["length"] + 4), "UTF-32")
    texts = F.transform("loss_spans", lambda s: unescaped(F.substring(cut(s), 2, 2**31 - 1)))
    return wide.withColumn("trained", texts).drop("__wide")


def op12_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = f"{END}{START}assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], rows.schema)
    chats = read_trained(formatted(rows.unionByName(own))).withColumn("turns", read_turns(F.col("formatted")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("trained", "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP12_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
near AS (SELECT *, lag(role) OVER w AS p, lead(role) OVER w AS n FROM rows WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
sized AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + CASE WHEN p = role THEN 10 ELSE 13 + length(role) END + CASE WHEN n = role THEN 0 ELSE 11 END AS chars FROM near)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
