"""Chat formatting with Spark expressions only: collected turn structs, sorted, merged by role, and concatenated.

Template: adjacent turns of one role form a run, written as ``### role: `` and then each turn's text closed by ``</turn>``.
Inside texts and roles a backslash becomes ``\\\\``, ``</turn>`` becomes ``<\\/turn>`` and ``##`` becomes ``#\\#`` (in roles a
colon also becomes ``\\:``), so neither mark can occur in them, and taking each backslash away from the character
behind it gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END, RUN = "</turn>", "###"


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), (TURN_END, "<\\/turn>"), ("##", "#\\#")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\/#:])", "$1")


def header(role: Column) -> Column:
    return F.concat(F.lit(f"{RUN} "), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(": "))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant", chunk_turns: int = 64) -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss_mask as array<struct<skip,take>>.

    Rows are ordered by turn (null first), ties by role and text; repeated rows stay repeated. Null role and text count as
    empty. The mask has an entry per turn: skip so many code points of formatted, then take so many; only texts of
    loss_role are taken, without marks. All rows with a null conv_id form one conversation; an empty table gives no rows;
    other columns are ignored.

    A long conversation is first formatted by ranges of chunk_turns turn numbers, spread over tasks; only the finished
    pieces of text meet in the conversation's row, which has to hold them anyway.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.floor(F.col(turn) / chunk_turns).alias("chunk"),
        F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    chunks = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # runs: adjacent turns of one role, with the escaped texts of each
    start = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def add(runs: Column, t: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        joined = F.struct(t["role"].alias("role"), F.concat(last["texts"], F.array(escape(t["text"]))).alias("texts"))
        fresh = F.struct(t["role"].alias("role"), F.array(escape(t["text"])).alias("texts"))
        return F.when(last["role"] == t["role"], F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(runs, F.array(fresh)))

    chunks = chunks.select("conv_id", "chunk", F.aggregate("turns", start, add).alias("runs"))
    body = F.transform(
        "runs",
        lambda r, i: F.concat(F.when(i == 0, F.lit("")).otherwise(header(r["role"])), F.array_join(F.transform(r["texts"], lambda x: F.concat(x, F.lit(TURN_END))), "")),
    )
    # (header, text, taken) code points of each turn; a run's header counts with its first turn
    sizes = F.flatten(
        F.transform("runs", lambda r: F.transform(r["texts"], lambda x, i: F.struct(F.when(i == 0, F.length(header(r["role"]))).otherwise(0).alias("head"), F.length(x).alias("size"), (r["role"] == loss_role).alias("loss"))))
    )
    chunks = chunks.select("conv_id", F.struct("chunk", F.col("runs")[0]["role"].alias("first"), F.element_at("runs", -1)["role"].alias("last"), F.array_join(body, "").alias("body"), sizes.alias("sizes")).alias("c"))
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    # a chunk that begins with the role that the one before ended with goes on with its run
    goes_on = F.transform("cs", lambda c, i: F.when(i == 0, F.lit(False)).otherwise(F.col("cs")[F.greatest(i - 1, F.lit(0))]["last"] == c["first"]))
    whole = whole.select("conv_id", "cs", goes_on.alias("on"))
    formatted = F.array_join(F.transform("cs", lambda c, i: F.concat(F.when(F.col("on")[i], F.lit("")).otherwise(header(c["first"])), c["body"])), "")
    flat = F.flatten(F.transform("cs", lambda c, k: F.transform(c["sizes"], lambda s, i: F.struct(F.when((i == 0) & F.col("on")[k], F.lit(0)).otherwise(s["head"]).alias("head"), s["size"].alias("size"), s["loss"].alias("loss")))))
    end = len(TURN_END)
    whole = whole.select("conv_id", formatted.alias("formatted"), flat.alias("flat"))
    # what follows a taken text up to its end mark is skipped by the next entry
    skip = F.transform(
        "flat",
        lambda s, i: F.struct(
            (s["head"] + F.when(s["loss"], F.lit(0)).otherwise(s["size"] + end) + F.when((i > 0) & F.coalesce(F.col("flat")[F.greatest(i - 1, F.lit(0))]["loss"], F.lit(False)), F.lit(end)).otherwise(F.lit(0))).alias("skip"),
            F.when(s["loss"], s["size"]).otherwise(0).alias("take"),
        ),
    )
    return whole.select("conv_id", "formatted", skip.alias("loss_mask"))


def read_chats(chats: DataFrame) -> DataFrame:
    """Reads formatted conversations back: conv_id, turns as array<struct<role,text>>, and loss_texts, the unescaped texts
    under the mask. A mask that doesn't end at the turns' ends raises an error."""
    runs = F.filter(F.split("formatted", RUN), lambda x: x != "")
    role = r"^ ((?:[^:\\]|\\.)*): "
    parsed = F.transform(runs, lambda r: F.struct(unescape(F.regexp_extract(r, role, 1)).alias("role"), F.split(F.regexp_replace(r, role, ""), TURN_END).alias("texts")))
    turns = F.flatten(F.transform(parsed, lambda r: F.transform(F.slice(r["texts"], 1, F.size(r["texts"]) - 1), lambda x: F.struct(r["role"].alias("role"), unescape(x).alias("text")))))
    # every entry of the mask lies in one turn, so each can be cut from its own piece of the split text
    pieces = chats.select("conv_id", "formatted", "loss_mask", F.split("formatted", TURN_END).alias("pieces"))
    piece = lambda i: F.col("pieces")[i]
    taken = F.transform("loss_mask", lambda m, i: F.when(m["take"] > 0, F.substr(piece(i), F.length(piece(i)) - m["take"] + 1, m["take"])).otherwise(F.lit("")))
    covered = F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, m: a + m["skip"] + m["take"])
    open_end = F.when(F.element_at("loss_mask", -1)["take"] > 0, len(TURN_END)).otherwise(0)
    fits = covered + open_end == F.length("formatted")
    checked = F.when(fits, F.transform(taken, unescape)).otherwise(F.raise_error(F.lit("the loss mask does not fit the text")).cast("array<string>"))
    return pieces.select("conv_id", "formatted", turns.alias("turns"), checked.alias("loss_texts"))
