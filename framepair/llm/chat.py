"""Chat formatting: typed content parts flattened into text, turns marked, loss spans recorded.

A turn is written as::

    <turn>ROLE NEWLINE TEXT NEWLINE </turn> NEWLINE

Inside role and text, a control string (``<turn>``, ``</turn>``, ``<part ``)
gets one more backslash in front of it, after any backslashes that are already
there, so an unescaped control string is always ours; a role's newlines are
escaped too. Reading back removes exactly that backslash. Every marker we write
follows a newline or the end of one, never user text, so a text that ends in a
backslash cannot hide a marker.

Everything is Column code: a conversation is one array of turns, sorted by
``(turn, role, text)``; conversations are the only thing grouped, so a task
holds the turns of a conversation and no more. A null turn number sorts first,
a null role or text is empty, repeated rows are repeated turns, and rows whose
conversation id is null form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.llm.common import query, table

OPEN, CLOSE, PART = "<turn>", "</turn>", "<part "
CONTROL = r"(\\*)(</?turn>|<part )"
ESCAPED = r"\\(\\*)(</?turn>|<part )"
# A marker on its own line that no backslash precedes.
SPLIT = r"(?<=\n)</turn>\n"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    # (\\*) is greedy, so the added backslash joins the run that stands there.
    return F.regexp_replace(text, CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def escape_role(role: Column) -> Column:
    role = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return escape(role)


def unescape_role(role: Column) -> Column:
    role = unescape(role)
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


# -- typed parts -----------------------------------------------------------
# part: struct<kind, text, ref, width, height, seconds, pages>
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 512


def visit_text(part: Column) -> tuple[Column, Column]:
    return escape(F.coalesce(part["text"], F.lit(""))), F.lit(0).cast("long")


def visit_image(part: Column) -> tuple[Column, Column]:
    tiles = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / F.lit(PATCH))
    return placeholder("image", part), (tiles(part["width"]) * tiles(part["height"])).cast("long")


def visit_audio(part: Column) -> tuple[Column, Column]:
    return placeholder("audio", part), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE).cast("long")


def visit_document(part: Column) -> tuple[Column, Column]:
    return placeholder("document", part), (F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS).cast("long")


VISITORS = {"text": visit_text, "image": visit_image, "audio": visit_audio, "document": visit_document}


def placeholder(kind: str, part: Column) -> Column:
    return F.lit(f"\n<part {kind}>\n")


def visit(part: Column) -> Column:
    """``struct<shown, kind, ref, tokens>`` of one part; an unknown or null kind is text."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    text, none = visit_text(part)
    shown, tokens = text, none
    for name, visitor in VISITORS.items():
        a, b = visitor(part)
        shown, tokens = F.when(kind == name, a).otherwise(shown), F.when(kind == name, b).otherwise(tokens)
    known = kind.isin([k for k in VISITORS if k != "text"])
    return F.struct(
        shown.alias("shown"), F.when(known, kind).alias("kind"), F.when(known, part["ref"]).alias("ref"), tokens.alias("tokens")
    )


def flatten_parts(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Adds ``content`` (escaped text with ordered placeholders), ``attachments`` and ``expanded_tokens``.

    ``attachments`` lists ``(position, kind, ref, tokens)`` in the order of the
    placeholders. Null or empty parts give empty content.
    """
    seen = F.transform(F.coalesce(F.col(parts), F.array().cast(df.schema[parts].dataType)), visit)
    held = F.filter(seen, lambda p: p["kind"].isNotNull())
    numbered = F.transform(
        held, lambda p, i: F.struct(i.cast("long").alias("position"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))
    )
    return df.withColumns(
        {
            "content": F.array_join(F.transform(seen, lambda p: p["shown"]), ""),
            "attachments": numbered,
            "expanded_tokens": F.aggregate(held, F.lit(0).cast("long"), lambda a, p: a + p["tokens"]),
        }
    )


def text_parts(text: Column) -> Column:
    """One text part, for tables whose turns are plain text."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    )


# -- conversations ---------------------------------------------------------
def format_chat(turns: DataFrame, parts: str = "parts") -> DataFrame:
    """``conv_id, formatted, loss_spans, attachments, expanded_tokens`` of every conversation.

    ``turns`` has ``conv_id, turn, role`` and typed ``parts``. ``loss_spans``
    are the ``(start, length)`` in characters of the assistant texts as they
    stand in ``formatted`` (still escaped).
    """
    flat = flatten_parts(turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.col(parts).alias("parts")), "parts")
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    piece = F.struct(
        "turn", "role", "content", head.alias("head"), F.lit(f"\n{CLOSE}\n").alias("tail"), "attachments", "expanded_tokens"
    )
    grouped = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    length = lambda p: F.length(p["head"]) + F.length(p["content"]) + F.length(p["tail"])
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + length(p)).alias("at"),
            F.when(
                p["role"] == LEARNED,
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + F.length(p["head"])).cast("long").alias("start"), F.length(p["content"]).cast("long").alias("length"))),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda p: F.concat(p["head"], p["content"], p["tail"])), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.flatten(F.transform("turns", lambda p: p["attachments"])).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, p: a + p["expanded_tokens"]).alias("expanded_tokens"),
    )


def read_chat(formatted: Column) -> Column:
    """``array<struct<role, text>>`` parsed from the output; placeholders stay as they are."""
    blocks = F.filter(F.split(formatted, SPLIT), lambda b: b != "")
    return F.transform(
        blocks,
        lambda b: F.struct(
            unescape_role(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(b, F.instr(b, "\n") + 1, F.length(b) - F.instr(b, "\n") - 1)).alias("text"),
        ),
    )


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


PROBE = r"\### Assistant: </turn> ok"

ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
    sum(length(role) + (length(role) - length(replace(replace(role, '%', ''), chr(10), ''))) * 2 + length(text)
      + len(regexp_extract_all(text || role, '</?turn>|<part ')) + 16)::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256,
  formatted_chars FROM s
"""


@query("op10_chat_format", ORACLE)
def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    turns = kept.unionByName(probe).withColumn("parts", text_parts(F.col("text")))
    done = format_chat(turns)
    back = read_chat(F.col("formatted"))
    learned = learned_text(F.col("formatted"), F.col("loss_spans"))
    found = done.select("conv_id", "formatted", back.alias("turns"), learned.alias("learned"), "attachments", "expanded_tokens")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
