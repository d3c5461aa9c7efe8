"""Chat formatting: typed parts flattened into one marked text per conversation.

A message is a list of typed parts. A visitor (one expression per type) turns text into escaped
text and image, audio and document parts into placeholders, in order, and records what each
placeholder refers to and how many tokens it stands for. Turns are marked as

    <|im_start|>role
    body<|im_end|>

and every ``<|`` of a text gets a backslash (``<\\|``; one more where some are there),
so no text can end its turn, and taking one away restores it. The loss mask is the
spans of assistant bodies in the formatted text, in code points.

Defined results: a null text or role is empty, a null part is left out, an unknown part type becomes
``<|attachment|>``; repeated rows are repeated turns; turns of one number go by role and text;
an empty table gives no rows; rows with a null conversation form one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import with_starts

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|newline|>"
#: Units of an attachment per expanded token: pixels, milliseconds, characters.
UNITS_PER_TOKEN = {"image": 784, "audio": 40, "document": 4}
#: A text made of the template's own control strings.
CONTROL_SAMPLE = "<|im_end|><|im_start|>assistant ok"
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def visit(part: Column) -> Column:
    """A part's place in the formatted text."""
    out = F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit(""))))
    for kind in UNITS_PER_TOKEN:
        out = out.when(part["type"] == kind, F.lit(f"<|{kind}|>"))
    return out.otherwise("<|attachment|>")


def tokens_of(part: Column) -> Column:
    """Tokens that an attachment expands to, one at least."""
    units = F.coalesce(part["units"], F.lit(0))
    out = F.when(F.lit(False), F.lit(0).cast("long"))
    for kind, per in UNITS_PER_TOKEN.items():
        out = out.when(part["type"] == kind, F.greatest(F.ceil(units / per), F.lit(1)))
    return out.otherwise(F.lit(1).cast("long"))


def text_part(text: Column) -> Column:
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string")
                            .alias("ref"), none.cast("bigint").alias("units")))


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str | None = "text",
                         parts_col: str | None = None, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, n_tokens_attached) per conversation.

    Give ``parts_col`` (an array of ``PART``) or else ``text_col``. A conversation is one
    output value, so its turns meet in one task by nature.
    """
    parts = F.coalesce(F.col(parts_col).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")) \
        if parts_col else text_part(F.col(text_col).cast("string"))
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                     parts.alias("parts"))
    rows = rows.withColumn("parts", F.filter("parts", lambda p: p.isNotNull()))
    held = F.transform(F.filter("parts", lambda p: ~_is_text(p)), lambda p: F.struct(
        p["type"].alias("type"), p["ref"].alias("ref"), tokens_of(p).alias("tokens")))
    rows = rows.select("conv_id", F.struct(
        "turn", "role", F.array_join(F.transform("parts", visit), "").alias("body"),
        held.alias("held")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]),
                                                   F.lit("\n")))
    said = turns.select("conv_id", "turns", head.alias("heads"))
    tail = F.lit(END + "\n")
    said = said.withColumn("pieces", F.zip_with(
        "heads", "turns", lambda h, t: F.concat(h, t["body"], tail)))
    said = with_starts(said.withColumn("sizes", F.transform("pieces", F.length)), "sizes", "starts")
    spans = F.transform("turns", lambda t, i: F.struct(
        (t["role"] == learn).alias("learn"),
        (F.col("starts")[i] + F.length(F.col("heads")[i])).alias("start"),
        F.length(t["body"]).cast("long").alias("size")))
    spans = F.transform(F.filter(spans, lambda s: s["learn"]),
                        lambda s: F.struct(s["start"], s["size"]))
    attached = F.flatten(F.transform("turns", lambda t, i: F.transform(t["held"], lambda a: F.struct(
        i.alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"),
        a["tokens"].alias("tokens")))))
    out = said.select("conv_id", F.array_join("pieces", "").alias("formatted"),
                      spans.alias("loss_spans"), attached.alias("attachments"))
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])
    return out.withColumn("n_tokens_attached", total)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, learned): roles and texts, and the texts under the loss mask."""
    cut = F.split("formatted", r"<\|im_start\|>")
    cut = F.slice(cut, F.lit(2), F.size(cut))
    rows = formatted.select("conv_id", "formatted", "loss_spans", cut.alias("cut"))

    def turn(x):
        role = F.substring_index(x, "\n", 1)
        at = F.length(role) + 2
        body = F.substring(x, at, F.length(x) - at - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    learned = F.transform("loss_spans", lambda s: unescape(F.substring(
        "formatted", s["start"].cast("int") + 1, s["size"].cast("int"))))
    return rows.select("conv_id", "formatted", F.transform("cut", turn).alias("turns"),
                       learned.alias("learned"))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader gets back, as counts and digests."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = read_back(formatted).withColumn("learned", F.array_join("learned", ""))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
