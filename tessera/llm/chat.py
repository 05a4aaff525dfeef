"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context
and only that reply is trainable. A conversation that does not end with an assistant turn
adds one record without a trainable part, so that the output holds every turn. A turn is
written as ``[INST]role[/INST]text</s>`` and an example begins with ``<s>``. A control
string inside a role or text gets one backslash more after its bracket than it has, which
``unescape`` takes away again, so a text can neither end its turn nor begin another.

Only DataFrame functions are used. A conversation is put together once, by one shuffle of
its turns; its examples are made and read where it lies. An example holds its whole
context by definition, so the output of one conversation grows with the square of its turns.

Defined cases: a null role or text counts as empty; turns stand in the order of turn, nulls
first, then role, then text; repeated rows are turns of their own; rows without a
conversation are one conversation; empty tables give none; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import require_columns

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
TRAINED_ROLE = "assistant"
_BARE = r"(\[(?=\\*/?INST\])|<(?=\\*/?s>))"
_ESCAPED = r"(\[(?=\\+/?INST\])|<(?=\\+/?s>))\\"


def escape(text: Column) -> Column:
    """No control string is left; ``unescape`` gives the text back."""
    return F.regexp_replace(text, _BARE, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def format_examples(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, whole, formatted, loss_start, loss_end) of each example of
    ``rows`` (conv_id, turn, role, text). ``n_turns`` are the turns it holds and number
    the examples of a conversation, ``whole`` says that these are all, and the trainable
    part of ``formatted`` runs from ``loss_start`` to ``loss_end``, in code points, end
    exclusive (equal: none)."""
    require_columns(rows, ["conv_id", "turn", "role", "text"], "conversations")
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    written = F.transform("turns", lambda t: F.struct((t["role"] == TRAINED_ROLE).alias("trained"), F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE)).alias("head"), escape(t["text"]).alias("body")))
    n = F.size("written")
    wanted = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.element_at("written", i)["trained"])
    example = turns.select("conv_id", written.alias("written")).select("conv_id", "written", n.alias("all"), F.explode(wanted).alias("n_turns"))
    last = F.element_at("written", F.col("n_turns"))
    context = F.array_join(F.transform(F.slice("written", F.lit(1), F.col("n_turns") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    before = example.select("conv_id", "n_turns", (F.col("n_turns") == F.col("all")).alias("whole"), last.alias("last"), F.concat(F.lit(BEGIN), context, last["head"]).alias("before"))
    start = F.length("before")
    return before.select(
        "conv_id", "n_turns", "whole", F.concat("before", "last.body", F.lit(END)).alias("formatted"),
        start.alias("loss_start"), (start + F.when(F.col("last.trained"), F.length("last.body")).otherwise(0)).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of an example as (role, text), read back from its string."""
    pieces = F.split(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), END, -1)
    held = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # nothing follows the last end

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, CLOSE, 1)
        role = F.substr(head, F.lit(len(OPEN) + 1))
        return F.struct(unescape(role).alias("role"), unescape(F.substr(piece, F.length(head) + len(CLOSE) + 1)).alias("text"))

    return F.transform(held, turn)


def read_trained(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example."""
    return unescape(F.substr(formatted, start + 1, end - start))


def read_back(examples: DataFrame) -> DataFrame:
    """Each conversation as its examples hold it: (conv_id, turns, trained, n_chars),
    where ``turns`` come from the whole record, ``trained`` are the trainable texts in
    order and ``n_chars`` is the length of all records. Examples of a conversation lie
    together as ``format_examples`` leaves them, so nothing is shuffled again."""
    trained = F.when(F.col("loss_end") > F.col("loss_start"), F.struct("n_turns", read_trained(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text")))
    read = examples.select("conv_id", F.length("formatted").cast("long").alias("n_chars"), F.when(F.col("whole"), read_turns(F.col("formatted"))).alias("turns"), trained.alias("trained"))
    held = read.groupBy("conv_id").agg(
        F.first("turns", ignorenulls=True).alias("turns"), F.sort_array(F.collect_list("trained")).alias("trained"), F.sum("n_chars").alias("n_chars")
    )
    return held.withColumn("trained", F.transform("trained", lambda t: t["text"]))
