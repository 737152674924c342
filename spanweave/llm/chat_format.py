"""Chat formatting with Spark expressions only: one string and one loss mask per conversation.

A conversation's turns are collected as structs and sorted; adjacent turns of one role become one message whose texts
are joined by a separator, so that the turns can be read back:

    <|turn|>ROLE\\nTEXT[<|sep|>TEXT]*<|end|>\\n

Control strings inside a text or role are escaped: each gets a `~` behind its first character, and one that has such
`~` already gets one more, so taking one away again gives the text back whatever it was. Other chat templates' control
strings are escaped too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SEP, END, NEWLINE = "<|turn|>", "<|sep|>", "<|end|>\n", "<|nl|>"
#: Turns whose spans are gathered in one array before the arrays are joined.
STRETCH = 256
#: What follows the first character of a control string. None holds `<`, `[` or begins with `~`: matches never overlap.
_TAILS = r"\|(?:turn|sep|end|nl|im_start|im_end|endoftext)\|>|/?s>|/?INST\]"
_PLAIN, _ESCAPED = rf"([<\[])(~*)({_TAILS})", rf"([<\[])~(~*)({_TAILS})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_chats(
    turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: conv, formatted string, loss_spans array<struct<start int, length int>>.

    Spans count code points of `formatted` from 0 and hold just the (escaped) texts of `loss_role`, in order.
    Turns sort by (turn, role, text), a null turn first; repeated rows stay. A null text or role is the empty string;
    rows with a null conv form one conversation. No rows give no conversations. Other columns are ignored. A
    conversation is one output row, so its turns meet in one task by nature.
    """
    rows = turns.select(
        F.col(conv).alias("_c"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_t"),
    )
    sorted_turns = rows.groupBy("_c").agg(F.sort_array(F.collect_list("_t")).alias("_ts"))

    def part(t: Column, i: Column) -> Column:
        before = F.get(F.col("_ts"), i - 1)["role"]
        heading = F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(TURN), F.replace(escape(t["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
        lead = F.when((i > 0) & (before == t["role"]), F.lit(SEP)).otherwise(heading)
        return F.struct(lead.alias("lead"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["pos"] + F.length(p["lead"])
        span = F.array(F.struct(start.alias("start"), F.length(p["body"]).alias("length")))
        return F.struct((start + F.length(p["body"])).alias("pos"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    none = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
    origin = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<int>)").alias("starts"))

    def spans_of(turns: Column) -> Column:
        """Spans of a stretch of turns, from its own start; an array grows by copying, so stretches are short."""
        return F.aggregate(turns, none, step)

    stretches = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_p") / F.lit(STRETCH)).cast("int") - 1), lambda i: spans_of(F.slice("_p", i * STRETCH + 1, F.lit(STRETCH))))
    onward = lambda acc, x: F.struct((acc["pos"] + x["pos"]).alias("pos"), F.concat(acc["starts"], F.array(acc["pos"])).alias("starts"))
    starts = F.aggregate("_s", origin, onward)["starts"]
    parts = sorted_turns.select("_c", F.transform("_ts", part).alias("_p"))
    text_of = F.concat(F.array_join(F.transform("_p", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(END))
    told = parts.select("_c", text_of.alias("formatted"), stretches.alias("_s")).withColumn("_starts", starts)
    moved = lambda x, i: F.transform(x["spans"], lambda s: F.struct((s["start"] + F.get("_starts", i)).alias("start"), s["length"].alias("length")))
    return told.select(F.col("_c").alias(conv), "formatted", F.flatten(F.transform("_s", moved)).alias("loss_spans"))


def read_back(formatted: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """The inverse: conv, turns array<struct<role, text>>, loss_text (what the loss spans cover, unescaped), formatted_chars.

    A null formatted string has no turns and an empty loss text.
    """

    def turns_of(message: Column) -> Column:
        line = F.substring_index(message, "\n", 1)
        name = unescape(F.replace(F.substr(line, F.lit(len(TURN) + 1)), F.lit(NEWLINE), F.lit("\n")))
        texts = F.split(F.substr(message, F.length(line) + 2), r"<\|sep\|>")
        return F.transform(texts, lambda x: F.struct(name.alias("role"), unescape(x).alias("text")))

    messages = F.filter(F.split(F.coalesce("formatted", F.lit("")), r"<\|end\|>\n"), lambda m: m != "")
    spans = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select(
        F.col(conv),
        F.flatten(F.transform(messages, turns_of)).alias("turns"),
        F.coalesce(F.array_join(spans, ""), F.lit("")).alias("loss_text"),
        F.coalesce(F.length("formatted"), F.lit(0)).cast("long").alias("formatted_chars"),
    )


def digests(back: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what read_back() gave."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col(conv),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
