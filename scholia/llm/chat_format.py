r"""Chat formatting: turns become one marked string, with a loss mask, and can be read back from it.

Template. A message is ``<|start|>role<|text|>turn<|end|>`` and a line feed. Adjacent turns of one role are one
message, their texts divided by ``<|turn|>``, so the turns are not lost. Inside roles and texts ``\``, ``<`` and
``[`` become ``\b``, ``\l`` and ``\k``: no control string, of this or a bracketed template, can then occur in a text,
and the change is undone exactly. The loss mask is a list of code-point spans, one for each assistant turn.

Method. Turn structs are collected and sorted by (turn, role, text); a turn opens or closes a message when its
neighbour has another role; Spark's array functions join the parts and add up the spans.

Defined results: null text or role counts as empty; equal turns are ordered by role and text; repeated rows stay;
a null conv_id is a conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, read, running, text_blocks

START, TEXT, TURN, END = "<|start|>", "<|text|>", "<|turn|>", "<|end|>\n"
CODES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\k"))
PROBE_TEXT = "</s>[INST] ok [/INST]"
PROBE_ID = -7


def escape(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of rows (conv_id, turn, role, text); spans are half open, from 0."""
    t = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(t)).alias("turns"))

    def pieces(ts: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            opens = (i == 0) | (F.get(ts, i - 1)["role"] != x["role"])
            closes = (i == F.size(ts) - 1) | (F.get(ts, i + 1)["role"] != x["role"])
            return F.struct(
                F.when(opens, F.concat(F.lit(START), escape(x["role"]), F.lit(TEXT))).otherwise(F.lit(TURN)).alias("head"),
                escape(x["text"]).alias("body"),
                F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"),
                (x["role"] == "assistant").alias("loss"),
            )

        return F.transform(ts, piece)

    def spans(ps: Column) -> Column:
        def placed(ends: Column) -> Column:
            def span(p: Column, i: Column) -> Column:
                end = F.get(ends, i) - F.length(p["tail"])
                return F.struct((end - F.length(p["body"])).cast("long").alias("start"), end.cast("long").alias("end"), p["loss"].alias("loss"))

            return F.transform(F.filter(F.transform(ps, span), lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

        sizes = F.transform(ps, lambda p: (F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).cast("long"))
        return let(sizes, lambda v: let(running(v, lambda a, b: a + b), placed))

    convs = convs.select("conv_id", let(F.col("turns"), lambda ts: let(pieces(ts), lambda ps: F.struct(
        F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        spans(ps).alias("loss_spans"),
    ))).alias("c"))
    return convs.select("conv_id", "c.formatted", "c.loss_spans")


def read_chats(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string."""
    messages = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda m: m != "")

    def turns_of(m: Column) -> Column:
        head = F.substring_index(m, TEXT, 1)
        body = F.substring(m, F.length(head) + len(TEXT) + 1, F.length(m))
        role = unescape(F.substring(head, F.lit(len(START) + 1), F.length(head)))
        return let(role, lambda r: F.transform(F.split(body, r"<\|turn\|>"), lambda x: F.struct(r.alias("role"), unescape(x).alias("text"))))

    return F.flatten(F.transform(messages, turns_of))


def loss_text(formatted: Column, spans: Column) -> Column:
    return let(text_blocks(formatted), lambda blocks: F.array_join(F.transform(spans, lambda s: unescape(cut(blocks, s["start"], s["end"]))), ""))


def with_probe(turns: DataFrame) -> DataFrame:
    """Adds conversation -7, whose texts are control strings of a common template."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = turns.sparkSession.range(0, 2, 1, 1).select(F.lit(PROBE_ID).cast("long"), "id", role, F.lit(PROBE_TEXT))
    return turns.select("conv_id", "turn", "role", "text").union(probe)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = format_chats(with_probe(read(spark, sf_dir, "conversations")))
    back = done.select("conv_id", "formatted", read_chats(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(x: str) -> str:
    return rf"replace(replace(replace({x}, '\', '\b'), '<', '\l'), '[', '\k')"


OP2_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'
), m AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER w AS opens FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_sql_escaped('text')}) + CASE WHEN opens THEN {len(START + TEXT + END)} + length({_sql_escaped('role')}) ELSE {len(TURN)} END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
