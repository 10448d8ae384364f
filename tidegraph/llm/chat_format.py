"""Chat formatting with Spark expressions only.

Rows of a conversation are collected as structs and sorted by turn; adjacent turns of one role become one
block (array functions); blocks are concatenated. A block is

    <|turn|>role<|text|>text<|next|>text<|end|>

with ``<|next|>`` between the texts of a merged block, so that the original turns can be read back.
Control strings inside roles and texts (these four, and those of ``FOREIGN`` that tokenizers of other
templates know) get an escape mark after their first character, and the escape mark is doubled, which
one regular expression undoes. The loss mask is an array of code-point spans of the assistant's texts.

``collect_list`` combines on the map side; a conversation is one row of output and so has to fit in
one, but no other group is formed. Defined results: null texts and roles are empty; null turn numbers come
last, equal ones sort by role, then text; a null conversation id is a conversation; extra columns are ignored; an empty
table gives only what ``extra`` adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
MARK = "\u241b"
LOSS_ROLE = "assistant"


def controls() -> tuple[str, ...]:
    return (TURN, TEXT, NEXT, END, *FOREIGN)


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit(MARK), F.lit(MARK * 2))
    for x in controls():
        c = F.replace(c, F.lit(x), F.lit(x[0] + MARK + x[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, f"(?s){MARK}(.)", "$1")


def _quoted(x: str) -> str:
    return rf"\Q{x}\E"


def _parts(blocks: Column) -> Column:
    """One struct for each text in order: code points of the text, of what precedes it since the last, and its mask."""

    def texts(b: Column) -> Column:
        head = F.length(b["role"]) + len(TURN) + len(TEXT)
        return F.transform(b["texts"], lambda t, i: F.struct(F.length(t).alias("size"), F.when(i == 0, head).otherwise(len(NEXT)).alias("head"), F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).alias("tail"), b["loss"].alias("loss")))

    return F.flatten(F.transform(blocks, texts))


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: id, ``formatted``, ``loss_spans``, ``n_blocks``."""
    one = F.struct(F.col(turn_col).isNull().alias("none"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = turns.groupBy(F.col(id_col)).agg(F.array_sort(F.collect_list(one)).alias("_t"))
    rows = rows.withColumn("_s", F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: (i == 0) | (F.get("_t", i)["role"] != F.get("_t", i - 1)["role"])))

    def block(start: Column, j: Column) -> Column:
        many = F.coalesce(F.get("_s", j + 1), F.size("_t")) - start
        role = F.get("_t", start)["role"]
        return F.struct(escape(role).alias("role"), (role == LOSS_ROLE).alias("loss"), F.transform(F.slice("_t", start + 1, many), lambda t: escape(t["text"])).alias("texts"))

    rows = rows.select(id_col, F.transform("_s", block).alias("_b"))
    text = F.array_join(F.transform("_b", lambda b: F.concat(F.lit(TURN), b["role"], F.lit(TEXT), F.array_join(b["texts"], NEXT), F.lit(END))), "")
    rows = rows.select(id_col, text.alias("formatted"), _parts(F.col("_b")).alias("_p"), F.size("_b").alias("n_blocks"))
    starts = running(F.transform("_p", lambda p: p["head"] + p["size"] + p["tail"]))
    spans = F.zip_with("_p", starts, lambda p, at: F.struct((at + p["head"]).alias("start"), (at + p["head"] + p["size"]).alias("end"), p["loss"].alias("loss")))
    spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["end"]))
    return rows.select(id_col, "formatted", spans.alias("loss_spans"), "n_blocks")


def read_chats(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The turns in ``formatted`` as an array of (role, text), and the unescaped text under the mask."""
    blocks = F.slice(F.split("formatted", _quoted(TURN), -1), 2, 1 << 30)

    def turns(b: Column) -> Column:
        parts = F.split(b, _quoted(TEXT), 2)
        texts = F.split(F.regexp_replace(parts[1], _quoted(END) + r"\z", ""), _quoted(NEXT), -1)
        return F.transform(texts, lambda t: F.struct(unescape(parts[0]).alias("role"), unescape(t).alias("text")))

    # Four bytes a code point, so that a span is found without counting from the start; one array element for
    # each span refers to the same bytes.
    wide = F.array_repeat(F.encode("formatted", "UTF-32"), F.size("loss_spans"))
    under = F.zip_with(wide, "loss_spans", lambda w, s: unescape(F.decode(F.substring(w, s["start"] * 4 + 1, (s["end"] - s["start"]) * 4), "UTF-32")))
    return chats.select(id_col, F.flatten(F.transform(blocks, turns)).alias("turns"), F.array_join(under, "").alias("loss_text"), F.length("formatted").alias("formatted_chars"), "n_blocks")


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    back = read_chats(format_chats(rows.unionByName(extra)))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


def _sql_escape(x: str) -> str:
    x = f"replace({x}, '{MARK}', '{MARK * 2}')"
    for c in controls():
        x = f"replace({x}, '{c}', '{c[0] + MARK + c[1:]}')"
    return x


OP6_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) IS DISTINCT FROM role AS opens FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_sql_escape('text')}) + CASE WHEN opens THEN {len(TURN) + len(TEXT) + len(END)} + length({_sql_escape('role')})
    ELSE {len(NEXT)} END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
