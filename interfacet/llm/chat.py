r"""Chat formatting in DataFrame functions only.

A message is `### role: text </turn>` and a line end. Adjacent turns of one role are merged into one
message, `#+#` standing between their texts. Backslashes are put into these strings where they occur
in a text or a role (and before each backslash), so that reading back is exact.

Null texts and roles are empty; turns with equal numbers are ordered by role and text; repeated rows
are turns of their own; rows without conv_id form one conversation; an empty table gives an empty
result; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, COLON, JOIN, CLOSE = "### ", ": ", "#+#", " </turn>\n"  # fixed values of the template


def escape(text: Column) -> Column:
    r"""`\`, `#` and the `/` of `</` get a backslash: no control string is left."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(": "), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def split_at(text: Column, mark: str) -> Column:
    return F.split(text, rf"\Q{mark}\E", -1)


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (start and length in bytes of each text to learn, UTF-8, from 0)."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def pieces(t: Column) -> Column:
        """What each turn adds to the output: head, body and tail."""
        n = F.size(t)

        def one(x: Column, i: Column) -> Column:
            new = (i == 0) | (F.get(t, i - 1)["role"] != x["role"])
            last = (i == n - 1) | (F.get(t, i + 1)["role"] != x["role"])
            head = F.when(new, F.concat(F.lit(OPEN), escape_role(x["role"]), F.lit(COLON))).otherwise(F.lit(JOIN))
            return F.struct(head.alias("head"), escape(x["text"]).alias("body"), F.when(last, F.lit(CLOSE)).otherwise(F.lit("")).alias("tail"), (x["role"] == loss_role).alias("loss"))

        return F.transform(t, one)

    parts = chats.select("conv_id", bind(F.col("t"), pieces).alias("p"))
    size = lambda c: F.octet_length(c).cast("long")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,bytes:long>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + size(x["head"])
        span = F.struct(start.alias("start"), size(x["body"]).alias("bytes"))
        return F.struct((start + size(x["body"]) + size(x["tail"])).alias("at"), F.when(x["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    formatted = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["tail"])), "")
    return parts.select("conv_id", formatted.alias("formatted"), F.aggregate("p", state, step)["spans"].alias("loss_spans"))


def read_chat(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text, formatted: read back from what format_chat returns."""

    def turns_of(message: Column) -> Column:
        colon = F.instr(message, COLON)
        role = unescape(F.substring(message, F.lit(len(OPEN) + 1), colon - (len(OPEN) + 1)))
        body = F.substring(message, colon + len(COLON), F.length(message))
        return F.transform(split_at(body, JOIN), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    messages = F.filter(split_at(F.col("formatted"), CLOSE), lambda m: m != "")
    turns = F.flatten(F.transform(messages, turns_of))
    under = bind(F.encode("formatted", "utf-8"), lambda raw: F.transform("loss_spans", lambda s: unescape(F.decode(F.substring(raw, (s["start"] + 1).cast("int"), s["bytes"].cast("int")), "utf-8"))))
    return chats.select("conv_id", turns.alias("turns"), F.array_join(under, "").alias("loss_text"), "formatted")


def digests(chats: DataFrame) -> DataFrame:
    """The contract's columns from read_chat's."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
