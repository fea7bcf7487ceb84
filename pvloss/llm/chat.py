"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds an ordered array of parts (type, text, ref, n_tokens). The visitor walks the parts
of each message and flattens them into one string: text is escaped and kept, every attachment
(image, audio, document, any other type) becomes a placeholder <|type:k|> where k is its position
among the attachments of the message. Attachments are recorded beside the text as
(part, type, ref, n_tokens), n_tokens being the tokens that the placeholder expands to later.

Template of one message: <|im_start|>ROLE \\n TEXT <|im_end|> \\n. Inside roles and texts the escape
character U+241B and the opening "<|" are rewritten, so no text can forge a marker and unescape()
gives the text back exactly. Roles also rewrite \\n, which ends the role in the template.

Defined cases: a null text, role, part or part array counts as empty; a null turn sorts first;
equal turns are ordered by role, then by the rendered text; repeated rows are kept; a null
conversation id is a conversation of its own; further input columns are ignored; empty tables give
empty results. Messages are rendered row by row, and placed by a window that streams over a conversation;
format_chats() makes one string of each conversation, so its messages meet in one row at the end, in time
linear in their size. Where conversations are too large for one row, messages() is the result to keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESC = "␛"
START, END = "<|im_start|>", "<|im_end|>\n"
PART = "struct<type:string,text:string,ref:string,n_tokens:bigint>"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit(ESC), F.lit(ESC + "e"))
    return F.replace(c, F.lit("<|"), F.lit(ESC + "l"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit(ESC + "l"), F.lit("<|")), F.lit(ESC + "b"), F.lit("<"))
    return F.replace(c, F.lit(ESC + "e"), F.lit(ESC))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(ESC + "n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(ESC + "n"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A plain text as the part array of a message."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("n_tokens")))


def visit_parts(parts: Column) -> Column:
    """parts (array of PART) -> struct(body, attachments, attachment_tokens)."""
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    files = F.filter(parts, lambda p: ~is_text(p))
    numbered = F.transform(files, lambda p, k: F.struct(k.cast("int").alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["n_tokens"], F.lit(0)).cast("bigint").alias("n_tokens")))
    # The k-th attachment takes the k-th placeholder: its number is the count of attachments before it.
    pieces = F.transform(
        parts,
        # A "<" that ends a part could open a marker with the next part, so it is rewritten there too.
        lambda p, i: F.when(is_text(p), F.when(i < F.size(parts) - 1, F.regexp_replace(escape(F.coalesce(p["text"], F.lit(""))), "<\\z", ESC + "b")).otherwise(escape(F.coalesce(p["text"], F.lit(""))))).otherwise(
            F.concat(F.lit("<|"), escape_role(p["type"]), F.lit(":"), F.size(F.filter(F.slice(parts, F.lit(1), i), lambda q: ~is_text(q))).cast("string"), F.lit("|>"))
        ),
    )
    return F.struct(
        F.array_join(pieces, "").alias("body"),
        numbered.alias("attachments"),
        F.aggregate(numbered, F.lit(0).cast("bigint"), lambda acc, a: acc + a["n_tokens"]).alias("attachment_tokens"),
    )


def messages(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, parts) -> conv_id, message (its number from 0), role, head, body,
    attachments, attachment_tokens, start: where each message stands in its conversation's string."""
    found = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visit_parts(F.col("parts")).alias("v"))
    found = found.select("conv_id", "turn", "role", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), "v.body", "v.attachments", "v.attachment_tokens")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body", F.to_json("attachments"))
    size = F.length("head") + F.length("body") + len(END)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    return found.select("conv_id", (F.row_number().over(order) - 1).alias("message"), "role", "head", "body", "attachments", "attachment_tokens", before.alias("start"))


def format_chats(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """rows (conv_id, turn, role, parts) -> conv_id, formatted, loss_spans, attachments, attachment_tokens,
    n_turns. loss_spans are (start, length) in characters of `formatted`, one for each message of a role in
    loss_roles, over its body alone."""
    span = F.struct((F.col("start") + F.length("head")).alias("start"), F.length("body").cast("bigint").alias("length"))
    one = F.struct("message", F.concat("head", "body", F.lit(END)).alias("text"), F.when(F.col("role").isin(*loss_roles), span).alias("span"), "attachments", "attachment_tokens")
    chats = messages(rows).select("conv_id", one.alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    return chats.select(
        "conv_id",
        F.array_join("ms.text", "").alias("formatted"),
        F.filter("ms.span", lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("ms", lambda m: F.transform(m["attachments"], lambda a: F.struct(m["message"].alias("message"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens"))))).alias("attachments"),
        F.aggregate("ms.attachment_tokens", F.lit(0).cast("bigint"), lambda acc, n: acc + n).alias("attachment_tokens"),
        F.size("ms").cast("bigint").alias("n_turns"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text), unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda b: b != "")
    body = lambda b: F.substring_index(b, "<|im_end|>", 1)
    return F.transform(
        blocks,
        lambda b: F.struct(
            unescape_role(F.substring_index(body(b), "\n", 1)).alias("role"),
            unescape(F.substr(body(b), F.position(F.lit("\n"), body(b)) + 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digest(chats: DataFrame) -> DataFrame:
    """What the formatted strings give back: turns and masked text, as digests."""
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "attachment_tokens",
    )
