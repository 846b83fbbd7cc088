"""Chat formatting by Spark expressions alone: collected turns are sorted, adjacent turns of a role merged, and joined.

Template: a block for each run of turns of one role, ``<|im_start|>role<|im_sep|>text<|im_cut|>text<|im_end|>`` and a line feed,
with ``<|im_cut|>`` between merged turns. In roles and texts, a backslash is put into each control string (after its first
character, and after backslashes that stand there already), those of other common templates too, so that none is left; taking
one out again gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, CUT, END = "<|im_start|>", "<|im_sep|>", "<|im_cut|>", "<|im_end|>\n"
#: What may follow the first character of a control string (fixed values).
_TAIL = r"(?=\||/?s>|/?INST\]|<|/?SYS>>|start_of_turn>|end_of_turn>)"
#: Characters that spans are looked up in at a time.
_CHUNK = 4096


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_TAIL}", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\{_TAIL}", r"$1$2")


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss (start and length, in characters of ``formatted``, of each text
    of role ``trained``).

    turns: conv_id, turn, role, text. A null role or text is an empty one; null turns come first; turns that share a number are
    in the order of role and text, and repeated rows are turns of their own. Rows with a null conv_id are one conversation.
    An empty table gives no rows. Other columns are left out.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_ = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        """A turn's text with what stands before it: a new block, or a cut where the role is that of the turn before."""
        before = F.get("turns", i - 1)["role"]
        opened = F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))
        lead = F.when(i == 0, opened).when(before == t["role"], F.lit(CUT)).otherwise(F.concat(F.lit(END), opened))
        return F.struct(lead.alias("lead"), escape(t["text"]).alias("body"), (t["role"] == trained).alias("loss"))

    def spans(at: Column, p: Column) -> Column:
        start = at["at"] + F.length(p["lead"])
        own = F.array(F.struct(start.alias("start"), F.length(p["body"]).alias("length")))
        return F.struct((start + F.length(p["body"])).alias("at"), F.when(p["loss"], F.concat(at["loss"], own)).otherwise(at["loss"]).alias("loss"))

    def after(at: Column, part: Column) -> Column:
        return F.struct((at["at"] + part["at"]).alias("at"), F.concat(at["starts"], F.array(at["at"])).alias("starts"))

    # A fold copies the array it appends to, so it goes over sqrt(n) pieces at a time, and then over the sqrt(n) parts' lengths.
    zero = F.expr("named_struct('at', 0, 'loss', cast(array() as array<struct<start: int, length: int>>))")
    step = F.ceil(F.sqrt(F.size("pieces").cast("double"))).cast("int")
    parts = F.transform(F.sequence(F.lit(1), F.size("pieces"), step), lambda k: F.aggregate(F.slice("pieces", k, step), zero, spans))
    starts = F.aggregate("parts", F.expr("named_struct('at', 0, 'starts', cast(array() as array<int>))"), after)["starts"]
    # Zipped, so that a start is looked up and not worked out again for each span.
    moved = F.transform(F.arrays_zip("parts", "starts"), lambda z: F.transform(z["parts"]["loss"], lambda s: F.struct((s["start"] + z["starts"]).alias("start"), s["length"].alias("length"))))

    pieces = sorted_.select("conv_id", F.transform("turns", piece).alias("pieces"))
    joined = pieces.select("conv_id", F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(END)).alias("formatted"), parts.alias("parts"))
    return joined.withColumn("starts", starts).select("conv_id", "formatted", F.flatten(moved).alias("loss"))


def read_chats(chats: DataFrame) -> DataFrame:
    """What ``format_chats`` wrote, read back: conv_id, formatted, turns (role and text), trained (the texts under the loss spans)."""

    def turns(block: Column) -> Column:
        at = F.instr(block, SEP)
        role, body = F.substr(block, F.lit(1), at - 1), F.substr(block, at + len(SEP), F.length(block) - at - len(SEP) - len(END) + 1)
        return F.transform(F.split(body, r"<\|im_cut\|>", -1), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    def under(chunks: Column, s: Column) -> Column:
        """A span's text, from the chunks it lies in: to reach into a string is to walk there from its start."""
        first, last = F.floor(s["start"] / _CHUNK).cast("int"), F.floor((s["start"] + s["length"]) / _CHUNK).cast("int")
        return F.substr(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), s["start"] % _CHUNK + 1, s["length"])

    chunks = F.transform(F.sequence(F.lit(0), F.length("formatted"), F.lit(_CHUNK)), lambda k: F.substr(F.col("formatted"), k + 1, F.lit(_CHUNK)))
    # The array of one holds the chunks, so that they are cut once and not for each span.
    trained = F.transform(F.array(chunks), lambda c: F.transform("loss", lambda s: unescape(under(c, s))))
    blocks = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.lit(2), F.size(F.split("formatted", r"<\|im_start\|>", -1)))
    return chats.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), F.get(trained, F.lit(0)).alias("trained"))
