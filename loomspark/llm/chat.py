"""Relational chat formatting, in Spark expressions only.

Turns are collected per conversation as structs, sorted by (turn, role, text), and
adjacent turns of one role share a block.  The template:

    <s>  then for each block   user       [INST]a[+]b[/INST]
                               system     [SYS]a[+]b[/SYS]
                               assistant  [ANS]a[+]b</s>
                               any other  [ROLE]name[+]a[+]b[/ROLE]

``[+]`` stands between merged turns, so the turns themselves can be read back.  A
control string inside a text gets a backslash after its bracket (``<\\s>``), one more
where it already has some, which ``unescape`` takes away again: every text comes back
as it was and other text stays as it is.  ``loss_mask`` has, in order, the code points
of each non-empty piece of ``formatted`` and whether it is under the loss: assistant
texts are, without any control string.

``collect_list`` combines on the map side, so one row per conversation and map task is
shuffled.  A conversation's output is one string by definition; building it and
reading it back take time in proportion to its length.

Defined cases: null text is an empty text; null role is the role with the empty name;
null conv_id is a conversation of its own; null turns come first; repeated rows are
repeated turns; an empty table has no conversations; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What follows the bracket of a control string.
_CONTROL = r"s>|INST\]|SYS\]|ANS\]|ROLE\]|\+\]"
_OPENS = r"\[INST\]|\[SYS\]|\[ANS\]|\[ROLE\]"
_CLOSES = r"\[/INST\]|\[/SYS\]|</s>|\[/ROLE\]"
#: Of control strings: all begin with one of two signs and end with one of two, which is looked at first.
_ANY = rf"<s>|\[\+\]|{_OPENS}|{_CLOSES}"
_EDGE = rf"(?<=[>\]])(?<={_ANY})|(?=[<\[])(?={_ANY})"


def escape(text: Column) -> Column:
    out = F.regexp_replace(text, rf"([<\[]/?)(\\*)({_CONTROL})", r"$1\\$2$3")
    return F.when(text.contains("[") | text.contains("<"), out).otherwise(text)


def unescape(text: Column) -> Column:
    out = F.regexp_replace(text, rf"([<\[]/?)\\(\\*)({_CONTROL})", "$1$2$3")
    return F.when(text.contains("\\"), out).otherwise(text)


def _by_role(role: Column, user: str, system: str, assistant: str, other: str) -> Column:
    c = F.when(role == "user", user).when(role == "system", system)
    return c.when(role == "assistant", assistant).otherwise(other)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask: array of (n, loss), one row a conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))

    def piece(text: Column | str, loss: Column | None = None) -> Column:
        text = F.lit(text) if isinstance(text, str) else text
        return F.struct(text.alias("text"), (F.lit(False) if loss is None else loss).alias("loss"))

    def pieces(t: Column, i: Column) -> Column:
        role, before = t["role"], F.get("_turns", i - 1)["role"]
        close = ("[/INST]", "[/SYS]", "</s>", "[/ROLE]")
        starts, ends = (before != role) | (i == 0), i == F.size("_turns") - 1
        named = starts & ~role.isin("user", "system", "assistant")
        return F.array(
            piece(F.when(i == 0, "<s>").when(starts, _by_role(before, *close)).otherwise("")),
            piece(F.when(starts, _by_role(role, "[INST]", "[SYS]", "[ANS]", "[ROLE]")).otherwise("[+]")),
            piece(F.when(named, escape(role)).otherwise("")),
            piece(F.when(named, "[+]").otherwise("")),
            piece(escape(t["text"]), role == "assistant"),
            piece(F.when(ends, _by_role(role, *close)).otherwise("")),
        )

    chats = chats.select("conv_id", F.flatten(F.transform("_turns", pieces)).alias("_pieces"))
    mask = F.transform(
        F.filter("_pieces", lambda p: p["text"] != ""),
        lambda p: F.struct(F.char_length(p["text"]).alias("n"), p["loss"].alias("loss")),
    )
    return chats.select("conv_id", F.array_join(F.col("_pieces.text"), "").alias("formatted"), mask.alias("loss_mask"))


def _after_first(items: Column) -> Column:
    return F.filter(items, lambda x, i: i > 0)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = _after_first(F.split(formatted, rf"(?=\[)(?={_OPENS})"))

    # Each step is bound in a struct, so that a block is split once however many turns it holds.
    def cut(block: Column) -> Column:
        open_, role, close = F.lit("[ROLE]"), F.lit(None).cast("string"), F.lit("[/ROLE]")
        for sign, name, end in (("[INST]", "user", "[/INST]"), ("[SYS]", "system", "[/SYS]"), ("[ANS]", "assistant", "</s>")):
            here = block.startswith(sign)
            open_, role, close = (F.when(here, x).otherwise(y) for x, y in ((sign, open_), (name, role), (end, close)))
        first = F.char_length(open_)
        inner = F.substr(block, first + 1, F.char_length(block) - first - F.char_length(close))
        return F.struct(role.alias("role"), F.split(inner, r"\[\+\]").alias("parts"))

    def named(b: Column) -> Column:
        texts = F.when(b["role"].isNull(), _after_first(b["parts"])).otherwise(b["parts"])
        return F.struct(F.coalesce(b["role"], unescape(b["parts"][0])).alias("role"), texts.alias("texts"))

    def turns(b: Column) -> Column:
        return F.transform(b["texts"], lambda x: F.struct(b["role"].alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.transform(F.transform(blocks, cut), named), turns))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped; null where mask and output do not agree."""
    found = F.filter(F.split(formatted, _EDGE), lambda x: x != "")
    both = F.zip_with(found, mask, lambda x, m: F.struct(x.alias("text"), m.alias("m")))

    def masked(pieces: Column) -> Column:
        agree = F.forall(pieces, lambda b: F.coalesce(F.char_length(b["text"]) == b["m"]["n"], F.lit(False)))
        under = F.transform(F.filter(pieces, lambda b: b["m"]["loss"]), lambda b: unescape(b["text"]))
        return F.when(agree, F.array_join(under, ""))

    return F.transform(F.array(both), masked)[0]  # the pieces are cut once


def digest(chats: DataFrame) -> DataFrame:
    """What the formatted output says when it is read back."""
    read = chats.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("_turns"),
        read_loss(F.col("formatted"), F.col("loss_mask")).alias("_loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("_loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
