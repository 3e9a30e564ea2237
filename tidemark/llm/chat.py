r"""Chat formatting in budgeted windows.

Each turn's tokens are counted (``TURN_COST`` for its marks and one for each ``CHARS_PER_TOKEN``
characters), and prefix sums of the counts run over the conversation. A window starts at a turn and takes
turns as long as its new turns, the repeated ones and the system turn stay within the budget: with prefix
sums S, turns i to j cost S(j) - S(i - 1). Windows after the first repeat the system turn and the last
turns before them, as many as fit in the history's share. Only assistant texts that are new in a window
carry the loss, so each is a target once. A turn larger than the budget has a window of its own and stays whole.

The template marks a turn as ``### Role: text</turn>`` and a line end. In texts and roles a backslash
goes before each backslash, ``###`` and ``</turn>``, so that marks can't be forged; reading takes it away again.

Rows of one conversation are streamed in order through one task, with the turns of one window in memory;
whole conversations are never gathered.

Defined results: null text or role is empty; turns that share a number are ordered by role and text; a
null turn number comes first; rows with a null conversation id form one conversation; an empty table gives
no windows; extra columns are ignored.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET = 512
HISTORY = 128
TURN_COST = 4
CHARS_PER_TOKEN = 4
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"

_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_TURN = re.compile(r"### ((?:[^\\:]|\\.|:(?! ))*): ((?:[^\\<]+|\\\\|\\###|\\</turn>|<(?!/turn>))*+)</turn>\n", re.S)
WINDOWS = "conv_id {kind}, window int, first_turn long, context_turns int, tokens long, formatted string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], context: int) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of turns and the spans of the assistant texts after the first ``context`` turns."""
    parts, loss, at = [], [], 0
    for k, (role, text) in enumerate(turns):
        head, body = OPEN + escape(role).replace(": ", ":\\ ") + AFTER_ROLE, escape(text)
        if k >= context and role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), loss


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1].replace(":\\ ", ": ")), unescape(m[2])))
        at = m.end()
    return out


def tokens_column(text: str) -> Column:
    return (F.ceil(F.length(F.coalesce(text, F.lit(""))) / CHARS_PER_TOKEN) + TURN_COST).cast("long")


class _Conversation:
    """The windows of one conversation, turn by turn, from the prefix sums."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple | None = None
        self.recent: list[tuple] = []
        self.context: list[tuple] = []
        self.fresh: list[tuple] = []
        self.number = 0

    def _context(self) -> list[tuple]:
        """The system turn and the latest turns whose prefix sums differ by no more than the history's share."""
        kept, top = [], self.recent[-1][3] if self.recent else 0
        for turn in reversed(self.recent):
            if top - (turn[3] - turn[2]) > self.history:
                break
            kept.insert(0, turn)
        return ([self.system] if self.system and self.system not in kept else []) + kept

    def add(self, role: str, text: str, cost: int, upto: int, index: int) -> tuple | None:
        """Take a turn whose tokens are ``cost`` and prefix sum ``upto``; returns the window that it closes, if any."""
        out, turn = None, (role, text, cost, upto, index)
        if index == 0 and role == "system":
            self.system = turn
        if self.fresh:
            repeated = sum(t[2] for t in self.context)
            if repeated + upto - (self.fresh[0][3] - self.fresh[0][2]) > self.budget:
                out = self.close()
                self.context = self._context()
                while self.context and sum(t[2] for t in self.context) + cost > self.budget and self.context[-1] is not self.system:
                    self.context.pop(1 if self.context[0] is self.system else 0)
        self.fresh.append(turn)
        self.recent.append(turn)
        top = upto - self.history
        while len(self.recent) > 1 and self.recent[0][3] - self.recent[0][2] < top:
            self.recent.pop(0)
        return out

    def close(self) -> tuple:
        turns = self.context + self.fresh
        formatted, loss = render([t[:2] for t in turns], len(self.context))
        out = (self.number, self.fresh[0][4], len(self.context), sum(t[2] for t in turns), formatted, [{"start": a, "end": b} for a, b in loss])
        self.number, self.fresh = self.number + 1, []
        return out


def _windows(budget: int, history: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, rows = None, None, []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
            rows.clear()
            return out

        for batch in batches:
            for c, role, text, cost, upto, index in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if state is None or c != conv:
                    if state:
                        rows.append((conv, *state.close()))
                    state, conv = _Conversation(budget, history), c
                if done := state.add(role, text, cost, upto, index):
                    rows.append((conv, *done))
                if len(rows) >= 1000:
                    yield flush()
        if state:
            rows.append((conv, *state.close()))
        if rows:
            yield flush()

    return run


def format_windows(
    df: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Windows of all conversations: conv_id, window, first_turn (its first new turn, from 0), context_turns
    (how many turns at its head are repeated), tokens, formatted, loss (spans in ``formatted``).

    Windows of a conversation come in order, and one after the other, within a partition.
    """
    kind = df.schema[conv_col].dataType
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    costed = rows.withColumn("cost", tokens_column("text"))
    summed = costed.withColumns({"upto": F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)), "index": F.row_number().over(order).cast("long") - 1})
    ordered = summed.select("conv", "role", "text", "cost", "upto", "index")
    ddl = WINDOWS.format(kind=kind.simpleString())
    empty = df.sparkSession.createDataFrame([], ddl)
    from pyspark.sql.pandas.types import to_arrow_schema

    return ordered.mapInArrow(_windows(budget, history, to_arrow_schema(empty.schema)), ddl)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its windows in order: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_windows.

    A digest of a whole conversation is sequential, so its windows are streamed through one task and
    hashed as they pass; none is kept. ``windows`` must come as ``format_windows`` returns them.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, rows = None, None, []

        def result() -> dict:
            return {"conv_id": conv, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4], "n_windows": state[5]}

        def flush(like: pa.Field) -> pa.RecordBatch:
            names = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())]
            out = pa.RecordBatch.from_pylist(rows, pa.schema([pa.field("conv_id", like.type), *(pa.field(*n) for n in names)]))
            rows.clear()
            return out

        like = None
        for batch in batches:
            like = batch.schema.field("conv_id")
            for w in batch.select(["conv_id", "context_turns", "formatted", "loss"]).to_pylist():
                if state is None or w["conv_id"] != conv:
                    if state:
                        rows.append(result())
                    conv, state = w["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse(w["formatted"])[w["context_turns"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in w["loss"]:
                    target = unescape(w["formatted"][span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(w["formatted"])
                state[5] += 1
            if len(rows) >= 1000:
                yield flush(like)
        if state:
            rows.append(result())
        if rows:
            yield flush(like)

    return windows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
