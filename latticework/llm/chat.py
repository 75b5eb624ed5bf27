"""Chat formatting in budgeted windows (operator 6).

Template: a turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  In roles and texts a
backslash stands before each backslash and before each part of ``<|`` and ``|>``
(a line feed in a role becomes backslash, n), so no text can open or close a turn;
taking the backslashes out gives the text again.

Windows: a conversation's turns, in order, are cut into blocks of ``BLOCK`` turns.
Within a block, prefix sums of the turns' tokens choose turn-aligned spans: from
each span's first turn the longest run that fits the budget beside the repeated
turns.  Every window retains the conversation's system turn (its first turn, if
its role is system) and repeats at most ``REPEAT`` preceding turns of at most
``HISTORY`` tokens.  The loss mask covers the texts of assistant turns of the span
alone: a repeated turn was under the mask of its own window, so each assistant
text is under the mask once.  No turn is cut: one longer than the budget has a
window of its own.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import Scratch, join_counted, picked, shuffle_partitions, with_place
from latticework.llm.packing import encoder, vocabulary

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY, REPEAT, BLOCK = 1024, 256, 8, 64
SYSTEM, BEFORE, OWN = 0, 1, 2  # why a turn is in a block
_CONTROL = re.compile(r"\\|<(?=\|)|(?<=<)\||\|(?=>)|(?<=\|)>")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its escaped text begins and ends in it."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns read back from formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(f"{END}\n", line)
        turns.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def spans(tokens: list[int], history: list[int], system: int, inside: bool = False, budget: int = BUDGET) -> Iterator[tuple[int, int, int]]:
    """(first, end, repeated) of each window over a block's ``tokens``.

    ``history`` holds the tokens of the turns before the block, the nearest last;
    ``system`` those of the system turn, which is the block's first if ``inside``.
    """
    every = [*history, *tokens]
    sums = [0, *accumulate(every)]
    first = len(history)
    while first < len(every):
        room = budget - (0 if inside and first == len(history) else system)
        repeated = 0
        while repeated < min(REPEAT, first) and sums[first] - sums[first - repeated - 1] <= HISTORY and sums[first + 1] - sums[first - repeated - 1] <= room:
            repeated += 1
        end = max(first + 1, bisect_right(sums, room + sums[first - repeated]) - 1)
        yield first - len(history), end - len(history), repeated
        first = end


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[list[dict]]:
    """Runs of rows with equal ``key``; the input is sorted by it."""
    for _, rows in groupby((row for batch in batches for row in batch.to_pylist()), key=lambda r: [r[k] for k in key]):
        yield list(rows)


def block_windows(rows: list[dict], count: Callable[[str], int]) -> Iterator[dict]:
    """The windows of one block: its rows are the system turn, turns before it, and its own, each in order.

    ``count`` gives a formatted turn's tokens.
    """
    for r in rows:
        r["tokens"] = count(format_turn(r["role"], r["text"])[0])
    system = [r for r in rows if r["why"] == SYSTEM]
    before = [r for r in rows if r["why"] == BEFORE]
    own = [r for r in rows if r["why"] == OWN]
    inside = own[0]["at"] == 0 and own[0]["role"] == "system"
    system = own[:1] if inside else system
    for number, (first, end, repeated) in enumerate(spans([r["tokens"] for r in own], [r["tokens"] for r in before], sum(r["tokens"] for r in system), inside)):
        back = [*before, *own][len(before) + first - repeated : len(before) + first]
        # the system turn leads, unless it is in the span itself
        context = [*(system if first or not inside else []), *(r for r in back if not (inside and r is own[0]))]
        text, mask = "", []
        for k, r in enumerate([*context, *own[first:end]]):
            turn, a, b = format_turn(r["role"], r["text"])
            if k >= len(context) and r["role"] == "assistant":
                mask += [len(text) + a, len(text) + b]
            text += turn
        yield {"conv_id": own[0]["conv_id"], "window": own[0]["block"] * BLOCK + number, "context_turns": len(context), "formatted": text, "loss": mask}


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("context_turns", pa.int32()), ("formatted", pa.string()), ("loss", pa.list_(pa.int64()))])
    rows: list[dict] = []
    encode = encoder(*vocabulary())
    for group in _groups(batches, ("conv_id", "block")):
        rows += block_windows(group, lambda text: len(encode(text)))
        if len(rows) >= 256:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, schema)


def chat_windows(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each window: conv_id, window (ascending in a conversation), context_turns
    (how many leading turns are retained or repeated), formatted, and loss (starts and
    ends of the masked text in code points, in turn).

    Turns go by ``turn``, then role, then text; a null turn comes first, a null role
    or text counts as empty, rows with a null conv_id are one conversation.  A
    repeated row is a turn of its own.  Other columns are ignored.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "chat")
    empty = F.lit("")
    own = picked(turns, conv_id=(conv_id, "long"), turn=(turn, "long"), role=(role, "string"), text=(text, "string"))
    own = own.withColumns({c: F.coalesce(c, empty) for c in ("role", "text")})
    # ranges of the order, not conversations, are dealt out: a long one lies in many tasks
    placed = with_place(own, scratch, [F.col(c) for c in ("conv_id", "turn", "role", "text")])
    # no join on a null key: a string stands for it that no number is
    placed = placed.withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"), empty))
    starts = placed.groupBy("_conv").agg(F.min("place").alias("_first"), F.max("place").alias("_end"), F.count(F.lit(1)).alias("_turns"))
    placed = join_counted(placed, starts, "_conv", "_turns", scratch).withColumn("at", F.col("place") - F.col("_first"))
    block, last = F.floor(F.col("at") / BLOCK), F.floor((F.col("_end") - F.col("_first")) / BLOCK)
    here = lambda number, why: F.struct(number.alias("block"), F.lit(why).alias("why"))
    none = F.array().cast("array<struct<block:bigint,why:int>>")
    before = F.when((F.col("at") % BLOCK >= BLOCK - REPEAT) & (block < last), F.array(here(block + 1, BEFORE))).otherwise(none)
    system = F.when((F.col("at") == 0) & (F.col("role") == "system") & (last > 0), F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(last, F.lit(1))), lambda b: here(b, SYSTEM))).otherwise(none)
    parts = placed.withColumn("_in", F.explode(F.concat(F.array(here(block, OWN)), before, system))).select("conv_id", "role", "text", "at", "_in.block", "_in.why")
    order = ("conv_id", "block", "why", "at")
    dealt = parts.repartition(shuffle_partitions(spark), "conv_id", "block").sortWithinPartitions(*order)
    return dealt.mapInArrow(_windows, "conv_id long, window long, context_turns int, formatted string, loss array<long>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, its windows streamed in order."""
    out: list[tuple] = []
    for conv, rows in groupby((row for batch in batches for row in batch.to_pylist()), key=lambda r: r["conv_id"]):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = lost = chars = 0
        for row in rows:
            for role, text in parse(row["formatted"])[row["context_turns"] :]:
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            for a, b in zip(row["loss"][0::2], row["loss"][1::2], strict=True):
                part = unescape(row["formatted"][a:b])
                loss.update(part.encode("utf-8", "surrogatepass"))
                lost += len(part)
            chars += len(row["formatted"])
        out.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars))
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], list(names))


def read_back(windows: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its windows: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest is a sequential sum, so a conversation's windows pass through one
    task, in order and one at a time; its memory doesn't grow with them.
    """
    dealt = windows.repartition(shuffle_partitions(windows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
