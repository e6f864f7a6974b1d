"""Quotation linking: threads from quoted passages, messages without their quotes.

A line's quote level is the number of ``>`` marks before its text. Runs of lines of one level are passages. A message's own
passages (level 0) are hashed as whole runs, paragraphs and lines, after normalisation; a quoted passage links to the
earliest message of its conversation that has the same hash as own text. Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradrift.llm.common import small_side, text_or_empty
from terradrift.session import save_table

_MARKS = r"^((?:[ \t]*>)+)"
#: A line that introduces a quote ("On Monday X wrote:") in the four languages of the corpus.
_INTRODUCTION = r"(?i)^\s*(on|le|am|el)\b.*\b(wrote|a écrit|schrieb|escribió)\b.*:\s*$"


def parsed_lines(text: Column) -> Column:
    """Array of ``(level, words)`` per line: quote level and the text after the marks."""

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 1)
        return F.struct(F.regexp_count(marks, F.lit(">")).alias("level"), F.regexp_replace(line, _MARKS, "").alias("words"))

    return F.transform(F.split(text, "\r\n|\r|\n"), one)


def normalised(words: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(words), "\\s+", " "))


def _own(lines: Column) -> Column:
    """Text of the level-0 lines without the lines that introduce a quote; blank lines at both ends are cut."""
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(
        F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False)) & x["words"].rlike(_INTRODUCTION)))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["words"]), "\n"), r"^\s*\n|\s+$", "")


def _begins(lines: Column, paragraphs: bool):
    """Whether a passage starts at line ``i``: the level changes or, for paragraphs, a blank line lies before."""
    def begins(i: Column) -> Column:
        this, before = F.get(lines, i), F.get(lines, i - 1)
        change = (i == 0) | (this["level"] != before["level"])
        return change | (F.trim(before["words"]) == "") if paragraphs else change

    return begins


#: Stands before each passage while a message's passages are one string; in the text itself it counts as white space.
_CUT = "\x01"


def _head(kind: int, line: Column) -> Column:
    return F.concat(F.lit(str(kind)), line["level"].cast("string"), F.lit(":"))


def _passages(lines: Column, kind: int, paragraphs: bool) -> Column:
    """Passages as texts of kind, level, a colon and words. The lines are joined and split where passages start, in linear time."""
    begins = _begins(lines, paragraphs)
    marked = F.transform(lines, lambda x, i: F.concat(F.when(begins(i), F.concat(F.lit(_CUT), _head(kind, x))).otherwise(" "), x["words"]))
    return F.split(F.array_join(marked, ""), _CUT)


def link_quotes(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                min_chars: int = 8) -> DataFrame:
    """One row per message, ready to be read in reply order: sort by conversation, ``thread_turn``, ``turn``.

    Columns: ``conv_id, turn, role, own_text, n_quoted, n_linked, parent_turn, thread_turn, reply_depth``. ``own_text`` is the
    message without quotes and without lines that introduce them. ``n_quoted`` counts its quoted runs, ``n_linked`` its quoted runs,
    paragraphs and lines that were found. The parent is the message of the outermost linked level, of several the latest. A
    message that links to none starts a thread: its own turn, depth 0. A reply is always later than its parent, so the
    order by turn within a thread never puts an answer before what it answers.

    Passages under ``min_chars`` normalised characters link only as whole runs. Null text is empty; a null conversation or
    turn links with nothing. Repeated rows give repeated rows, of messages with equal turns none answers the other.
    """
    rows = messages.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), text_or_empty(text).alias("body"))
    rows = rows.withColumn("mark", F.xxhash64("role", "body")).withColumn("lines", parsed_lines(F.col("body")))
    quoting = F.exists("lines", lambda x: x["level"] > 0)
    lines = F.col("lines")
    plain = rows.withColumn("lines", parsed_lines(F.replace("body", F.lit(_CUT), F.lit(" "))))
    units = F.concat(_passages(lines, 0, False), _passages(lines, 1, True), F.transform(lines, lambda x: F.concat(_head(2, x), x["words"])))
    # An outer explode: for a plain one Spark would test the array's size first, with all of its expressions written out once more.
    units = plain.select("conv_id", "turn", "mark", F.explode_outer(units).alias("unit")).withColumn("head", F.substring_index("unit", ":", 1))
    units = units.select("conv_id", "turn", "mark", F.left("head", F.lit(1)).alias("kind"), F.substr("head", F.lit(2)).alias("level"),
                         normalised(F.substr("unit", F.length("head") + 2)).alias("norm"))
    units = units.filter((F.length("norm") > 0) & ((F.length("norm") >= min_chars) | (F.col("kind") == "0"))).select(
        "conv_id", "turn", "mark", F.col("level").cast("int").alias("level"), F.xxhash64("norm").alias("hash"), F.md5("norm").alias("digest"))
    units = save_table(units, "quote-units")

    # One row per passage and conversation: the earliest message that has it as own text.
    quoted = units.filter("level > 0").select("conv_id", "turn", "mark", "level", "hash", "digest").distinct()
    asked = save_table(quoted.select("conv_id", "hash", "digest").distinct(), "quote-asked")
    first = F.min(F.struct("turn", "mark")).alias("first")
    sources = units.filter("level = 0 AND turn IS NOT NULL").join(small_side(asked), ["conv_id", "hash", "digest"], "left_semi").groupBy(
        "conv_id", "hash", "digest").agg(first)
    sources = save_table(sources, "quote-sources")
    linked = quoted.join(small_side(sources), ["conv_id", "hash", "digest"]).filter(F.col("first.turn") < F.col("turn"))
    parents = linked.groupBy("conv_id", "turn", "mark").agg(
        F.count("*").alias("n_linked"), F.max(F.struct((-F.col("level")).alias("outer"), "first")).alias("best"))
    parents = parents.select("conv_id", "turn", "mark", "n_linked", F.col("best.first.turn").alias("up_turn"), F.col("best.first.mark").alias("up_mark"))
    parents = save_table(parents, "quote-parents")

    # Threads by pointer doubling: each round doubles the distance a message sees upwards.
    seen = save_table(parents.select("conv_id", "turn", "mark", "up_turn", "up_mark", F.lit(1).alias("depth")), "quote-threads")
    while True:
        above = seen.select("conv_id", F.col("turn").alias("up_turn"), F.col("mark").alias("up_mark"), F.col("up_turn").alias("far_turn"),
                            F.col("up_mark").alias("far_mark"), F.col("depth").alias("more"))
        longer = seen.join(above, ["conv_id", "up_turn", "up_mark"], "left")
        longer = save_table(longer.select(
            "conv_id", "turn", "mark", F.coalesce("far_turn", "up_turn").alias("up_turn"),
            F.when(F.col("far_turn").isNull(), F.col("up_mark")).otherwise(F.col("far_mark")).alias("up_mark"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved")), "quote-threads")
        moved = longer.filter("moved").limit(1).count()
        seen = longer.drop("moved")
        if not moved:
            break
    threads = save_table(seen.select("conv_id", "turn", "mark", F.col("up_turn").alias("thread_turn"), "depth").join(
        parents.select("conv_id", "turn", "mark", "n_linked", F.col("up_turn").alias("parent_turn")), ["conv_id", "turn", "mark"]), "quote-linked")

    begins = _begins(lines, False)
    n_quoted = F.when(quoting, F.size(F.filter(lines, lambda x, i: (x["level"] > 0) & begins(i)))).otherwise(0)
    out = rows.select("conv_id", "turn", "role", "mark", n_quoted.cast("bigint").alias("n_quoted"),
                      F.when(quoting, _own(lines)).otherwise(F.col("body")).alias("own_text"))
    out = out.join(small_side(threads), ["conv_id", "turn", "mark"], "left")
    return out.select(
        "conv_id", "turn", "role", "own_text", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "parent_turn",
        F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("reply_depth"))
