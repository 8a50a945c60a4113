"""Chat formatting (native).

Turns of a conversation are collected as structs, sorted, and adjacent turns of
one role are merged into a block; blocks are joined to one string::

    ### role: text</turn>\\n
    ### role: first<also/>second</turn>\\n        (a merged block)

Control strings inside roles and texts are escaped reversibly: a backslash
becomes ``\\s``, ``###`` ``\\h``, ``</turn>`` ``\\e``, ``<also/>`` ``\\j`` and in roles
``:`` ``\\c``. The loss mask lists the spans (code points) of assistant texts.

Defined cases: null texts and roles are empty; turns with equal numbers are
ordered by role and text, so repeated rows give repeated turns; a null number
comes first; rows without a conversation id form one conversation with a null id;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

OPEN, AFTER_ROLE, JOIN, CLOSE = "### ", ": ", "<also/>", "</turn>\n"
ESCAPES = [("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\e"), (JOIN, "\\j")]


def _replace(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape(text: Column) -> Column:
    return _replace(text, ESCAPES)


def unescape(text: Column) -> Column:
    return _replace(text, [(b, a) for a, b in reversed(ESCAPES)])


def format_chats(turns: DataFrame, train_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of structs ``start``, ``len``)."""
    part = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    grouped = turns.select("conv_id", part.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    # the index where each block starts; a block is a slice of the turns
    heads = lambda ts: F.filter(
        F.sequence(F.lit(0), F.size(ts) - 1), lambda i: F.coalesce(F.get(ts, i).role != F.get(ts, i - 1).role, F.lit(True))
    )

    def block(ts: Column, hs: Column) -> Column:
        return F.transform(
            hs,
            lambda h, k: F.struct(
                F.get(ts, h).role.alias("role"),
                F.transform(
                    F.slice(ts, h + 1, F.coalesce(F.get(hs, k + 1), F.size(ts)) - h), lambda t: escape(t.text)
                ).alias("texts"),
            ),
        )

    def head_of(b: Column) -> Column:
        return F.concat(F.lit(OPEN), F.replace(escape(b.role), F.lit(":"), F.lit("\\c")), F.lit(AFTER_ROLE))

    def written(b: Column) -> Column:
        return F.concat(head_of(b), F.array_join(b.texts, JOIN), F.lit(CLOSE))

    def spans(b: Column) -> Column:
        """Where the texts of a block stand in it."""
        return F.transform(
            b.texts,
            lambda t, k: F.struct(
                (
                    F.length(head_of(b))
                    + F.aggregate(F.slice(b.texts, F.lit(1), k), F.lit(0), lambda a, x: a + F.length(x) + F.lit(len(JOIN)))
                ).alias("start"),
                F.length(t).alias("len"),
            ),
        )

    def masked(bs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("spans"))

        def step(acc: Column, b: Column) -> Column:
            own = F.when(
                b.role == train_role,
                F.transform(spans(b), lambda s: F.struct((s.start + acc.at).alias("start"), s.len.alias("len"))),
            ).otherwise(F.array().cast("array<struct<start:int,len:int>>"))
            return F.struct((acc.at + F.length(written(b))).alias("at"), F.concat(acc.spans, own).alias("spans"))

        return F.aggregate(bs, start, step, lambda acc: acc.spans)

    blocks = let(F.col("turns"), lambda ts: let(heads(ts), lambda hs: block(ts, hs)))
    return grouped.select("conv_id", blocks.alias("blocks")).select(
        "conv_id", F.array_join(F.transform("blocks", written), "").alias("formatted"), masked(F.col("blocks")).alias("loss_spans")
    )


def parse_chats(formatted: Column) -> Column:
    """The turns (``role``, ``text``) that a formatted string holds."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turns(b: Column) -> Column:
        at = F.instr(b, AFTER_ROLE)
        role = unescape(F.replace(b.substr(F.lit(len(OPEN) + 1), at - len(OPEN) - 1), F.lit("\\c"), F.lit(":")))
        body = b.substr(at + len(AFTER_ROLE), F.length(b))
        return F.transform(F.split(body, JOIN), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted strings hold, read back from them."""
    under = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s.start + 1, s.len)))
    return chats.select(
        "conv_id", "formatted", parse_chats(F.col("formatted")).alias("turns"), F.array_join(under, "").alias("loss")
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
