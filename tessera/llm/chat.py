"""Chat formatting with Spark expressions only: sorted turn structs, merged blocks, one string a conversation.

Template of a block: ``<|start|>role<|body|>text<|sep|>text<|end|>``. Adjacent turns of one role share a block, their
texts aggregated to an array and parted by ``<|sep|>``, so every turn can be read back. Inside roles and texts the escape character is doubled
and every control string is broken after its first character, so no control string of a text survives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, table

START, BODY, SEP, END = "<|start|>", "<|body|>", "<|sep|>", "<|end|>"
ESCAPE = "\\"
#: Beginnings and whole forms of control strings, of this template and of others; each is broken by the escape.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted): one row a conversation.

    Turns go by turn number, null first; ties by role, then text. Null text: empty; null role: empty. A null
    conv_id is a conversation of its own. Repeated rows are separate turns. An empty table gives no rows; other
    columns are dropped.
    """
    none = F.lit("")
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), none).alias("role"), F.coalesce(F.col(text_col), none).alias("text")
    )
    chats = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def block(b: Column) -> Column:
        texts = F.array_join(F.transform(b["texts"], escape), SEP)
        return F.concat(F.lit(START), escape(b["role"]), F.lit(BODY), texts, F.lit(END))

    merged = F.array_join(F.transform(merge_turns(F.col("turns")), block), "")
    return chats.select("conv_id", merged.alias("formatted"))


def merge_turns(turns: Column) -> Column:
    """Array of struct(role, texts): adjacent turns of one role merged into an array of their texts.

    Each block is a slice of the sorted turns, so the time is linear in the conversation; a fold that appends to the
    last block would copy it at every turn.
    """

    def of(turns: Column) -> Column:
        begins = F.transform(turns, lambda t, i: F.when((i == 0) | (F.get(turns, i - 1)["role"] != t["role"]), i))

        def cut(starts: Column) -> Column:
            end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(turns))
            own = lambda s, k: F.slice(turns, s + 1, end(k) - s)
            return F.transform(starts, lambda s, k: F.struct(F.get(turns, s)["role"].alias("role"), F.transform(own(s, k), lambda t: t["text"]).alias("texts")))

        return let(F.filter(begins, lambda i: i.isNotNull()), cut)

    return let(turns, of)


def read_chats(formatted: Column) -> Column:
    """Array of struct(role, texts), one element a block, from a formatted conversation."""
    quoted = lambda s: s.replace("|", "\\|")
    blocks = F.filter(F.split(formatted, quoted(END)), lambda b: b != "")

    def block(b: Column) -> Column:
        parts = F.split(F.substring(b, len(START) + 1, 2**31 - 1), quoted(BODY))
        texts = F.transform(F.split(F.get(parts, F.lit(1)), quoted(SEP)), unescape)
        return F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), texts.alias("texts"))

    return F.transform(blocks, block)


def loss_text(blocks: Column) -> Column:
    """All text under the loss mask: the assistant's, unescaped, in order, nothing between."""
    own = F.filter(blocks, lambda b: b["role"] == "assistant")
    return F.array_join(F.flatten(F.transform(own, lambda b: b["texts"])), "")


def op4_chat(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    out = format_chats(rows.unionByName(extra))
    out = out.select("conv_id", "formatted", read_chats(F.col("formatted")).alias("blocks"))
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.concat(b["role"], F.lit("\n"), t, F.lit("\n")))))
    loss = loss_text(F.col("blocks"))
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "replace({0}, '\\', '\\\\')"
for _c in CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

OP4_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r),
b AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY i) = role, false) AS same FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format('text')})
    + CASE WHEN same THEN {len(SEP)} ELSE {len(START + BODY + END)} + length({_ESCAPED.format('role')}) END) AS BIGINT) AS formatted_chars
FROM b GROUP BY conv_id
"""
