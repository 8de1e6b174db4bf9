"""Chat formatting in budgeted windows.

Prefix sums of turn tokens give each turn its place in its conversation; cutting that line into blocks of the
token budget gives turn-aligned spans: the turns that lie within a block are one window, and the turn that
crosses a block's end is one of its own. Every window starts with the conversation's system turn (its first
turn, if the role is ``system``), repeats the last turns before it that fit ``history`` tokens, and adds its own
turns. Loss spans cover the texts of assistant turns in the window where they are new; repeated turns are
masked. Blocks and history share what the system turn leaves of ``capacity``: history has at most a quarter of it, and
blocks the rest. A long turn that crosses a block's end takes room from the history. So a window exceeds ``capacity`` only if
one turn and the system turn don't fit together, which ``over`` says; turns are never cut.

Template: ``### {role}: {text}</turn>`` and a line feed per turn. Inside roles and texts a backslash goes before
every backslash, ``###`` and ``</turn>`` (and ``:`` in roles), which ``parse`` undoes.

A conversation of any length is spread over tasks: prefix sums are local sums over range-sorted parts plus one
offset for each conversation that crosses parts, and a window's group holds at most two blocks of turns.

Defined cases: null text and null role are empty; null conv_id is a conversation; turns are ordered by turn
(nulls first), role, text, whatever the partitions are; repeated rows are turns; other columns are ignored; an empty
table gives no windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CAPACITY = 2048
HISTORY = 256

#: Blocks of a conversation that share one copy of its system turn while windows meet it.
LEAD_BLOCKS = 16

#: Characters of a text that ranges are cut by.
PREFIX = 200

CONTROL = re.compile(r"\\|###|</turn>")
CONTROL_OR_COLON = re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<]|<(?!/turn>))*)</turn>\n", re.DOTALL)

_WORKER: dict[str, Any] = {}


def escape(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where its escaped text begins and ends."""
    head = f"### {escape(role, CONTROL_OR_COLON)}: "
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn in a window."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def _tokens_udf(tokenizer: str):
    @F.arrow_udf("bigint")
    def tokens(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        if tokenizer not in _WORKER:
            _WORKER[tokenizer] = Tokenizer.from_file(tokenizer)
            _WORKER[tokenizer].encode_special_tokens = True
        for roles, texts in batches:
            whole = [formatted_turn(r or "", t or "")[0] for r, t in zip(roles.to_pylist(), texts.to_pylist(), strict=True)]
            yield pa.array([len(e.ids) for k in range(0, len(whole), 500) for e in _WORKER[tokenizer].encode_batch(whole[k : k + 500], add_special_tokens=False)], pa.int64())

    return tokens


def placed_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, role, text, tokens, nth (from 0), start (tokens before it) and system (tokens of its conversation's system turn, if any) of every turn."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(rows.withColumn("tokens", _tokens_udf(tokenizer)("role", "text")))
    key = ["conv_id", "turn", "role", F.substring("text", 1, PREFIX)]  # ranges cut nowhere between equal keys, so all follows the sort
    dealt = rows.repartitionByRange(*key).sortWithinPartitions("conv_id", "turn", "role", "text")
    kind, turn_kind = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, nth, start, lead = TaskContext.get().partitionId(), object(), 0, 0, None
        for b in batches:
            places, starts, leads = [], [], []
            for conv, role, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                if conv != last:
                    last, nth, start, lead = conv, 0, 0, n if role == "system" else None
                places.append(nth)
                starts.append(start)
                leads.append(lead)
                nth, start = nth + 1, start + n
            more = [pa.array([part] * b.num_rows, pa.int32()), *(pa.array(x, pa.int64()) for x in (places, starts, leads))]
            yield pa.record_batch([*b.columns, *more], names=[*b.schema.names, "part", "nth", "start", "system"])

    local = stored(dealt.mapInArrow(add, f"conv_id {kind}, turn {turn_kind}, role string, text string, tokens bigint, part int, nth bigint, start bigint, system bigint"))
    sums = local.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("s"), F.max("system").alias("lead"))
    spread = sums.groupBy("conv_id").agg(F.count("*").alias("parts")).filter("parts > 1").select(F.col("conv_id").alias("c"))  # no more than parts
    crossing = sums.join(spread, sums["conv_id"].eqNullSafe(F.col("c"))).drop("c")
    by_part = Window.partitionBy("conv_id").orderBy("part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    offset = crossing.select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"),
        F.first("lead").over(by_part).alias("lead"),  # what the conversation's first part begins with
    )
    out = local.join(offset, local["conv_id"].eqNullSafe(F.col("c")) & (local["part"] == F.col("p")), "left")
    return out.select(
        "conv_id", "role", "text", "tokens", (F.col("nth") + F.coalesce("n0", F.lit(0))).alias("nth"), (F.col("start") + F.coalesce("s0", F.lit(0))).alias("start"),
        F.when(F.col("c").isNotNull() | F.col("p").isNotNull(), F.col("lead")).otherwise(F.col("system")).alias("system"),
    )


WINDOW = pa.struct(
    [
        ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
        ("n_repeated", pa.int32()),
        ("n_new", pa.int32()),
        ("n_tokens", pa.int64()),
        ("over", pa.bool_()),
    ]
)


def _format_udf(capacity: int, history: int):
    @F.arrow_udf("struct<formatted:string,loss:array<struct<begin:int,end:int>>,n_repeated:int,n_new:int,n_tokens:bigint,over:boolean>")
    def build(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for turns, system, system_tokens in batches:
            out = []
            for rows, lead, lead_tokens in zip(turns.to_pylist(), system.to_pylist(), system_tokens.to_pylist(), strict=True):
                rows.sort(key=lambda r: r["nth"])
                own = [r for r in rows if r["own"]]
                start = own[0]["start"]
                left = capacity - (lead_tokens or 0)
                allowed = min(history, left // 4, left - sum(r["tokens"] for r in own))
                past = [r for r in rows if not r["own"] and start - r["start"] <= allowed and not (r["nth"] == 0 and lead is not None)]
                repeated = [{"role": "system", "text": lead, "tokens": lead_tokens}] if lead is not None and own[0]["nth"] else []
                repeated += past
                parts, loss, size = [], [], 0
                for k, r in enumerate([*repeated, *own]):
                    whole, begin, end = formatted_turn(r["role"], r["text"])
                    if k >= len(repeated) and r["role"] == "assistant":
                        loss.append({"begin": size + begin, "end": size + end})
                    parts.append(whole)
                    size += len(whole)
                size = sum(r["tokens"] for r in [*repeated, *own])
                out.append({"formatted": "".join(parts), "loss": loss, "n_repeated": len(repeated), "n_new": len(own), "n_tokens": size, "over": size > capacity})
            yield pa.array(out, WINDOW)

    return build


def format_windows(turns: DataFrame, tokenizer: str, capacity: int = CAPACITY, history: int = HISTORY) -> DataFrame:
    """conv_id, block, crossing (their order is the order of windows), formatted, loss (spans in characters of
    ``formatted``), n_repeated (leading turns that are repeats), n_new, n_tokens, over: one row per window."""
    rows = stored(placed_turns(turns, tokenizer))
    left = F.greatest(F.lit(capacity) - F.coalesce("system", F.lit(0)), F.lit(0))
    sized = rows.withColumn("past", F.least(F.lit(history), F.floor(left / 4))).withColumn("room", F.greatest(left - F.col("past"), F.lit(1)).cast("long"))
    sized = sized.withColumn("block", F.floor(F.col("start") / F.col("room")))
    sized = sized.withColumn("crossing", (F.col("start") + F.col("tokens") > (F.col("block") + 1) * F.col("room")).cast("int"))
    place = lambda block, crossing, own: F.struct(block.alias("block"), crossing.alias("crossing"), F.lit(own).alias("own"))
    block = F.col("block")
    next_start = (block + 1) * F.col("room")
    later: Column = F.when(next_start - F.col("start") <= F.col("past"), F.array(place(block + 1, F.lit(0), False), place(block + 1, F.lit(1), False))).otherwise(F.array().cast("array<struct<block:bigint,crossing:int,own:boolean>>"))
    within: Column = F.when(F.col("crossing") == 0, F.array(place(block, F.lit(1), False))).otherwise(F.array().cast("array<struct<block:bigint,crossing:int,own:boolean>>"))
    spread = sized.withColumn("at", F.explode(F.concat(F.array(place(block, F.col("crossing"), True)), within, later)))
    # a copy for a window that doesn't exist (no own turn there) is dropped after grouping
    turn = F.struct("nth", "start", "role", "text", "tokens", F.col("at.own").alias("own"))
    groups = spread.groupBy("conv_id", F.col("at.block").alias("block"), F.col("at.crossing").alias("crossing")).agg(F.collect_list(turn).alias("turns"), F.bool_or("at.own").alias("some")).filter("some").drop("some")
    # a copy of the system turn for each LEAD_BLOCKS blocks, so that no task gets all windows of a long conversation
    first = F.when((F.col("nth") == 0) & (F.col("role") == "system"), F.struct(F.col("text").alias("system"), F.col("tokens").alias("system_tokens")))
    lead = sized.groupBy("conv_id").agg(F.max(first).alias("s"), F.max("block").alias("last")).filter("s IS NOT NULL")
    lead = lead.select(F.col("conv_id").alias("c"), "s.*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / LEAD_BLOCKS))).alias("stretch"))
    met = groups["conv_id"].eqNullSafe(lead["c"]) & (F.floor(groups["block"] / LEAD_BLOCKS) == lead["stretch"])
    full = groups.join(lead, met, "left").drop("c", "stretch")
    return full.select("conv_id", "block", "crossing", _format_udf(capacity, history)("turns", "system", "system_tokens").alias("w")).select("conv_id", "block", "crossing", "w.*")


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of what the windows say, per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation's windows are read in order from one sorted partition and hashed as they pass; nothing is gathered.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        state: list = []

        def row() -> dict:
            conv, n, turns, chars, loss, total, windows_ = state
            return dict(zip(names, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, windows_), strict=True))

        for b in batches:
            done = []
            for w in b.to_pylist():
                if not state or state[0] != w["conv_id"]:
                    if state:
                        done.append(row())
                    state = [w["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse(w["formatted"])[w["n_repeated"] :]:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in w["loss"]:
                    text = unescape(w["formatted"][span["begin"] : span["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(w["formatted"])
                state[6] += 1
            yield pa.RecordBatch.from_pylist(done, schema=out_schema)
        if state:
            yield pa.RecordBatch.from_pylist([row()], schema=out_schema)

    from pyspark.sql.pandas.types import to_arrow_type

    out_schema = pa.schema([("conv_id", to_arrow_type(windows.schema["conv_id"].dataType)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
    dealt = windows.select("conv_id", "block", "crossing", "formatted", "loss", "n_repeated").repartition("conv_id").sortWithinPartitions("conv_id", "block", "crossing")
    return dealt.mapInArrow(digest, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")
