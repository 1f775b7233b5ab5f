r"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events (conv_id, seq, msg, kind, body): ``open`` starts a message in the
role of its body, ``delta`` appends its body, ``edit`` replaces all text so far, ``regenerate`` drops
it and ``delete`` withdraws the message.  Folding the events of a message by sequence gives its final
text; rendering puts the messages of a conversation in order into one string:

    ### role: text</turn>

with an escaped role and text.  In both, a backslash is doubled, every ``#`` before another ``#`` and
every ``</`` get a backslash inside them, and in a role a colon gets one before it.  So neither
control string, ``###`` nor ``</turn>``, ever comes from a text, and dropping each backslash before
its character gives back what was there.  Beside the string stands its loss mask: the ranges of code
points that hold the (escaped) texts of assistants.

The log is partitioned by conversation and message, not by conversation alone, and folded so: a message's
events never touch another message's text, and a conversation that holds most of the log stays spread.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

HEAD, FOOT = "### ", "</turn>\n"
#: The role whose texts are learnt from.
LEARNT = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.regexp_replace(text, "#(?=#)", r"#\\"), F.lit("</"), F.lit("<\\/"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events(conversations: DataFrame, chunk: int = 512) -> DataFrame:
    """The log that a chat over the rows of (conv_id, turn, role, text) leaves, streamed in deltas of ``chunk`` code points.

    An assistant's message has a draft of one delta that is regenerated; the first piece of any other message
    is sent as a draft and then edited.  Rows go by turn, null turns first, then by role and text; repeated
    rows and turns are messages of their own; null roles and texts are empty.  ``msg`` is (turn, number of
    the row within its turn); ``seq`` extends it by the number of the event.
    """
    turn = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text", F.row_number().over(turn).alias("nth"))
    text = F.coalesce(F.col("text"), F.lit(""))
    event = lambda n, kind, body: F.struct((F.lit(n) if isinstance(n, int) else n).alias("n"), F.lit(kind).alias("kind"), body.alias("body"))
    piece = lambda k: F.substring(text, k * chunk + 1, F.lit(chunk))
    last = F.greatest(F.ceil(F.length(text) / chunk).cast("int") - 1, F.lit(0))
    deltas = lambda first: F.transform(F.filter(F.sequence(F.lit(0), last), lambda k: k >= first), lambda k: event(k + 3, "delta", piece(k)))
    begun = F.array(event(0, "open", F.coalesce("role", F.lit(""))), event(1, "delta", F.reverse(piece(F.lit(0)))))
    again = F.concat(begun, F.array(event(2, "regenerate", F.lit(""))), deltas(0))
    edited = F.concat(begun, F.array(event(2, "edit", piece(F.lit(0)))), deltas(1))
    one = rows.select("conv_id", "turn", "nth", F.explode(F.when(F.col("role") == LEARNT, again).otherwise(edited)).alias("e"))
    return one.select("conv_id", F.struct("turn", "nth", "e.n").alias("seq"), F.struct("turn", "nth").alias("msg"), "e.kind", "e.body")


def fold(log: DataFrame) -> DataFrame:
    """conv_id, msg, role, text of every message that is opened and not deleted.

    Only what follows the last edit or regeneration is gathered.  At one sequence number a regeneration comes
    first, then an edit (of several the last by body counts), then deltas by body; a repeated event
    counts once.  The role is that of the first ``open``.  Null bodies are empty; events of other kinds
    change nothing; other columns are ignored.
    """
    resets = F.col("kind").isin("edit", "regenerate")
    log = log.select("conv_id", "seq", "msg", "kind", F.coalesce("body", F.lit("")).alias("body"))
    log = log.repartition("conv_id", "msg").distinct()  # one exchange for repeats, resets and texts
    live = log.withColumn("reset", F.max(F.when(resets, F.col("seq"))).over(Window.partitionBy("conv_id", "msg")))
    counts = F.col("reset").isNull() | (F.col("seq") >= F.col("reset"))
    done = live.groupBy("conv_id", "msg").agg(
        F.min(F.when(F.col("kind") == "open", F.struct("seq", "body")))["body"].alias("role"),
        F.max(F.when((F.col("kind") == "edit") & counts, F.col("body"))).alias("edited"),
        F.array_sort(F.collect_list(F.when((F.col("kind") == "delta") & counts, F.struct("seq", "body")))).alias("deltas"),
        F.max(F.col("kind") == "delete").alias("gone"),
    )
    text = F.concat(F.coalesce("edited", F.lit("")), F.array_join(F.transform("deltas", lambda d: d["body"]), ""))
    return done.filter("role is not null and not gone").select("conv_id", "msg", "role", text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: one string for each conversation, with its messages in order, and its loss mask.

    ``loss`` has struct<start, end> in code points, ends excluded, for each message of an assistant.
    """
    role = F.concat(F.lit(HEAD), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(": "))
    m = messages.select("conv_id", "msg", (F.col("role") == LEARNT).alias("learnt"), role.alias("head"), escape(F.col("text")).alias("body"))
    m = m.withColumn("n", F.length("head") + F.length("body") + len(FOOT))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    m = m.select("conv_id", "msg", "learnt", F.concat("head", "body", F.lit(FOOT)).alias("turn"), (before + F.length("head")).alias("start"), F.length("body").alias("long"))
    whole = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", "turn", "learnt", "start", "long"))).alias("ms"))
    loss = F.transform(F.filter("ms", lambda x: x["learnt"]), lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["long"]).alias("end")))
    return whole.select("conv_id", F.array_join(F.transform("ms", lambda x: x["turn"]), "").alias("formatted"), loss.alias("loss"))


def parse(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation says."""
    turns = F.filter(F.split(formatted, F.lit(FOOT)), lambda t: t != "")
    head = r"(?s)^### ((?:[^\\:]|\\.)*+): (.*)$"
    return F.transform(turns, lambda t: F.struct(unescape(F.regexp_extract(t, head, 1)).alias("role"), unescape(F.regexp_extract(t, head, 2)).alias("text")))


def _plain(escaped: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", escaped)


def read_back(formatted: str, loss: list[tuple[int, int]]) -> tuple[int, str, int, str]:
    """What a reader of the output finds: turns and their digest, the length and digest of the text under the mask."""
    turns = formatted.split(FOOT)[:-1]
    said, learnt = hashlib.sha256(), "".join(_plain(formatted[a:b]) for a, b in loss)
    for t in turns:
        role, text = re.match(r"(?s)### ((?:[^\\:]|\\.)*+): (.*)\Z", t).groups()
        said.update(f"{_plain(role)}\n{_plain(text)}\n".encode())
    return len(turns), said.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def digest(rendered: DataFrame) -> DataFrame:
    """conv_id and what ``read_back`` says of each conversation, read from the string and the mask alone."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = b.column("formatted").to_pylist()
            ends = lambda k: b.column(k).to_pylist()
            found = [(*read_back(t, list(zip(x, y))), len(t)) for t, x, y in zip(texts, ends("starts"), ends("ends"))]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*found) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], [x.split()[0] for x in schema.split(", ")])

    ship(rendered.sparkSession)
    flat = rendered.select(F.col("conv_id").cast("long").alias("conv_id"), "formatted", F.col("loss.start").alias("starts"), F.col("loss.end").alias("ends"))
    return flat.mapInArrow(run, schema)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss of every conversation; one whose rows are all null texts has empty messages.

    A null conv_id is a conversation like others, no rows give no rows, and other columns are ignored.
    """
    return render(fold(events(conversations)))
