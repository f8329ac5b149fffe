r"""Chat formatting by prefix-target expansion.

Template: a turn is <|ROLE|>TEXT<|/|>. In roles and texts five characters are escaped, so that no
control string of this or another template of angle or square brackets is left inside:
\ is \e, < is \l, > is \g, [ is \b and ] is \d; in roles / is \s too, as <|/|> ends a turn.

Each assistant turn is an example of its own: the formatted conversation up to and with that reply;
only the reply is trainable. As an example is a prefix of the formatted conversation, a conversation
is put together once and cut per reply.

Turns are ordered by turn (nulls first), role and text. Null roles and texts are empty; a null conv_id is
a conversation. Repeated rows are turns of their own. Conversations without a reply give no example. Empty input: no
rows. Texts of any length; a conversation is one row, put together in one task. Columns other than these four are
ignored. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters and what stands for them, the escape itself first. Fixed values.
ESCAPES = [("\\", "\\e"), ("<", "\\l"), (">", "\\g"), ("[", "\\b"), ("]", "\\d")]

ROLE_ESCAPES = [*ESCAPES, ("/", "\\s")]


def escaped(c: Column, escapes: list[tuple[str, str]] = ESCAPES) -> Column:
    for a, b in escapes:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column, escapes: list[tuple[str, str]] = ESCAPES) -> Column:
    for a, b in reversed(escapes):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def formatted(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, spans): spans are places (start, chars) of the replies, from 0."""
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    head = F.concat(F.lit("<|"), escaped(F.col("role"), ROLE_ESCAPES), F.lit("|>"))
    part = F.struct("turn", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
    held = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("t"))
    whole = F.concat_ws("", F.transform("t", lambda x: F.concat(x.head, x.body, F.lit("<|/|>"))))

    def step(acc, x):
        start = acc.at + F.length(x.head)
        span = F.struct(start.alias("start"), F.length(x.body).alias("chars"))
        return F.struct((start + F.length(x.body) + 5).alias("at"), F.when(x.role == trained, F.array_append(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,chars:int>>)").alias("spans"))
    return held.select("conv_id", whole.alias("formatted"), F.aggregate("t", empty, step, lambda a: a.spans).alias("spans"))


def examples(form: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): one row per reply; only [loss_start, loss_end) is trainable."""
    rows = form.select("conv_id", "formatted", F.posexplode("spans").alias("example", "s"))
    end = F.col("s.start") + F.col("s.chars")
    return rows.select("conv_id", "example", F.expr("left(formatted, s.start + s.chars + 5)").alias("text"), F.col("s.start").alias("loss_start"), end.alias("loss_end"))


def read_turns(text: Column) -> Column:
    """Array of (role, text) from formatted text."""
    pieces = F.filter(F.split(text, r"<\|"), lambda x: (x != "") & (x != "/|>"))
    return F.transform(pieces, lambda x: F.struct(unescaped(F.substring_index(x, "|>", 1), ROLE_ESCAPES).alias("role"), unescaped(x.substr(F.length(F.substring_index(x, "|>", 1)) + 3, F.length(x))).alias("text")))


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation what a reader finds in the formatted output and in its examples."""
    form = formatted(turns)
    read = read_turns(F.col("formatted"))
    whole = form.select("conv_id", F.size(read).cast("long").alias("n_turns"), F.sha2(F.concat_ws("", F.transform(read, lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n")))), 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    reply = unescaped(F.expr("substring(text, loss_start + 1, loss_end - loss_start)"))
    loss = examples(form).select(F.col("conv_id").alias("of"), F.struct("example", reply.alias("reply")).alias("r")).groupBy("of").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list("r")), lambda x: x.reply)).alias("loss"))
    both = whole.join(loss, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    text = F.coalesce(F.col("loss"), F.lit(""))
    return both.select("conv_id", "n_turns", "turns_sha256", F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), "formatted_chars")


def oracle() -> str:
    def esc(c: str, escapes: list[tuple[str, str]] = ESCAPES) -> str:
        for a, b in escapes:
            c = f"replace({c}, '{a}', '{b}')"
        return c

    said = "'</s>[INST] ok [/INST]'"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', {said}), (-7::BIGINT, 1::BIGINT, 'assistant', {said})))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(length({esc('role', ROLE_ESCAPES)}) + length({esc('text')}) + 9)::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""
