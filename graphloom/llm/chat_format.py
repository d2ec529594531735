r"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor turns the parts of each turn - text, image, audio, document - into ordered segments: escaped text, or a
placeholder whose attachment reference and expanded token count are recorded.  In texts `\` becomes `\-` and `<` becomes
`\l`, so no control string (all begin with `<`) can stand in a text, and every backslash begins exactly one escape:
the change is undone without ambiguity.  Segments carry the loss mask; joined, they are the formatted conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens that a placeholder stands for: per 336-pixel image tile, second of audio, document page.
TILE, IMAGE_TOKENS, AUDIO_TOKENS, PAGE_TOKENS = 336, 576, 12.5, 1024
ATTACHED = ("image", "audio", "document")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\-")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\-"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit("\n")))


def expanded(part: Column) -> Column:
    """Tokens of an attachment; unknown sizes count as one tile, second or page."""
    tiles = F.ceil(F.coalesce(part["width"], F.lit(1)) / TILE) * F.ceil(F.coalesce(part["height"], F.lit(1)) / TILE)
    return F.when(part["type"] == "image", tiles * IMAGE_TOKENS).when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * AUDIO_TOKENS)).when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS).otherwise(0).cast("long")


def visit(role: Column, parts: Column) -> Column:
    """Segments (text, loss) of one turn. Text of the assistant is under the loss mask; unknown types become <|other|>."""
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    body = F.transform(parts, lambda p: F.when(F.coalesce(p["type"], F.lit("text")) == "text", segment(escaped(F.coalesce(p["text"], F.lit(""))), role == "assistant")).otherwise(segment(F.concat(F.lit("<|"), F.when(p["type"].isin(*ATTACHED), p["type"]).otherwise("other"), F.lit("|>")), F.lit(False))))
    return F.concat(F.array(segment(F.concat(F.lit(TURN), escaped_role(role), F.lit("\n")), F.lit(False))), body, F.array(segment(F.lit(END), F.lit(False))))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments, attachments (turn, part, type, ref, tokens), expanded_tokens.

    Turns go by turn, then role, then segments, nulls first; repeated rows are repeated turns.  A null role is empty,
    null parts are none, a null conv_id is one conversation.  One conversation is one value, so its turns meet in one
    task; everything but joining them happens before.  An empty table gives no rows.
    """
    role, parts = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    attached = F.filter(F.transform(parts, lambda p, i: F.struct(F.col(turn_col).cast("long").alias("turn"), i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens"))), lambda a: a["type"].isin(*ATTACHED))
    one = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), visit(role, parts).alias("segments"), attached.alias("attachments")).alias("t"))
    all_ = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    out = all_.select("conv_id", F.flatten("ts.segments").alias("segments"), F.flatten("ts.attachments").alias("attachments"))
    return out.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments", "attachments", F.aggregate("attachments.tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("expanded_tokens"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; placeholders stay in the text as they stand (parse_parts() tells
    them from a text that says the same)."""
    return turns_of(formatted, lambda body: unescaped(body).alias("text"))


def parse_parts(formatted: Column) -> Column:
    """The turns (role, parts) of a formatted conversation: parts are (type, text), neighbouring texts as one; a placeholder's
    text is null, and its attachment is the next of its turn."""

    def typed(piece: Column) -> Column:
        held = piece.startswith("<")
        return F.struct(F.when(held, F.substr(piece, F.lit(3), F.length(piece) - 4)).otherwise("text").alias("type"), F.when(~held, unescaped(piece)).alias("text"))

    # In texts < is escaped, so every < begins a placeholder.
    return turns_of(formatted, lambda body: F.transform(F.regexp_extract_all(body, F.lit(r"<\|[a-z]+\|>|[^<]+"), F.lit(0)), typed).alias("parts"))


def turns_of(formatted: Column, read) -> Column:
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x, i: i > 0)

    def one(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.length(role) + 2, F.length(piece) - F.length(role) - (1 + len(END)))
        return F.struct(unescaped_role(role).alias("role"), read(body))

    return F.transform(pieces, one)


def text_turns(df: DataFrame) -> DataFrame:
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), *(F.lit(None).cast(k).alias(n) for n, k in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    return df.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def digest(out: DataFrame) -> DataFrame:
    """Of what stands in the output: turns from the formatted string, loss from the masked segments."""
    read = out.select("conv_id", parse(F.col("formatted")).alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"), unescaped(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")).alias("loss"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(hard).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    return digest(format_conversations(text_turns(df.unionByName(extra))))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
a AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(8 + length(replace(replace(replace(role, '\', '\-'), '<', '\l'), chr(10), '\n')) + 1 + length(replace(replace(text, '\', '\-'), '<', '\l')) + 8)::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""
