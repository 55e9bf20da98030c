"""Reply trees to conversations: paths, ranking and a reversible chat template.

Method. Messages point to the message they reply to. Self-joins double each message's reach: after round k every
message knows its ancestor 2**k steps up and the sum of scores on the way, so a tree of depth d takes log2(d)
rounds. Leaves are ranked in each tree by the mean score of their path; the best are kept. The same tables, applied from
the longest step down, expand each chosen leaf into its root-to-leaf path, and each path is formatted as
one conversation.

Template. ``<<SYS>>…<</SYS>>`` for system, ``[INST]…[/INST]`` for user, ``<s>…</s>`` for assistant; any other role is
``<<ROLE>>name<</ROLE>>`` before ``[INST]``. In texts and names a backslash is doubled and a control string
gets a backslash after its first character, which :func:`unescape` takes back; so no text
holds a control string. The loss mask is a list of spans, one for each assistant text.

Defined results. Null text and null role are empty strings. A message whose parent does not exist is a root. A message without an id is left out of
trees; a cycle has no leaf and so no path. Of several messages with one id in a tree the least by (parent, role, text, score) counts, nulls first.
Ties in score go to the smaller leaf id. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WorkArea

#: The template's control strings.
CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<</ROLE>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_UNIT = re.compile(r"(?:(<<ROLE>>)(.*?)<</ROLE>>)?(<<SYS>>|\[INST\]|<s>)(.*?)(<</SYS>>|\[/INST\]|</s>)", re.DOTALL)
_MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_ROLES = {v[0]: k for k, v in _MARKS.items()}


def escape(text: str) -> str:
    out = text.replace("\\", "\\\\")
    # Taking a control string apart can join no new one: the character put in occurs in none.
    while True:
        new = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], out)
        if new == out:
            return out
        out = new


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\\" if m[1] == "\\" else m[1], text, flags=re.DOTALL)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans of assistant texts in code points)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        opening, closing = _MARKS.get(role, _MARKS["user"])
        if role not in _MARKS:
            opening = f"<<ROLE>>{escape(role)}<</ROLE>>{opening}"
        body = escape(text)
        start = at + len(opening)
        if role == "assistant":
            spans.append((start, start + len(body)))
        out += (opening, body, closing)
        at = start + len(body) + len(closing)
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _UNIT.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[2]) if m[1] else _ROLES[m[3]], unescape(m[4])))
        at = m.end()
    return out


def linear_tree(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of linear conversations: each turn replies to the one before; equal turns go by role, then text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("msg", F.row_number().over(order).cast("long")).select("conv", "msg", (F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(messages: DataFrame, area: WorkArea, best: int = 1, most_rounds: int = 40) -> DataFrame:
    """(conv, leaf, rank, turns): root-to-leaf paths, the ``best`` of each tree, turns an array of (role, text) in order.

    ``messages``: conv, msg, parent, role, text, score.
    """
    named = messages.where("msg is not null").withColumn("tree", F.coalesce(F.col("conv").cast("string"), F.lit("\0null")))
    one = named.groupBy("tree", "msg").agg(F.min(F.struct("parent", "role", "text", "score", "conv")).alias("m"))  # the least of repeated ids
    base = area.table(one.select("tree", "msg", "m.*"), "messages")
    longest = base.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    most_rounds = min(most_rounds, longest.bit_length() + 1)  # what is unfinished then runs in a cycle
    ids = base.select("tree", "msg")
    up = base.select("tree", "msg", F.col("parent").alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("depth"))
    up = up.join(ids.select("tree", F.col("msg").alias("up"), F.lit(True).alias("there")), ["tree", "up"], "left")
    reached = F.when(F.col("there"), F.col("up"))
    step = area.table(up.select("tree", "msg", reached.alias("up"), "total", "depth", reached.isNull().alias("ended")), "up-0")
    steps = [step]
    while not step.where("up is not null").isEmpty() and len(steps) < most_rounds:
        # Only unfinished messages are joined, and only trees that have some are carried on: one deep tree costs the others nothing.
        open_ = step.where("up is not null")
        live = step.join(open_.select("tree").distinct(), "tree", "left_semi")
        far = live.select("tree", F.col("msg").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        joined = open_.join(far, ["tree", "up"]).select(
            "tree", "msg", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("up2").isNull().alias("ended")
        )
        step = area.table(joined.unionByName(live.where("up is null").withColumn("ended", F.lit(False))), f"up-{len(steps)}")
        steps.append(step)
    ended = reduce(DataFrame.unionByName, (s.where("ended") for s in steps)).drop("ended")  # each message once, in the round that reached its root
    leaves = ended.join(base.where("parent is not null").select("tree", F.col("parent").alias("msg")).distinct(), ["tree", "msg"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "msg"))
    paths = leaves.withColumn("rank", rank).where(F.col("rank") <= best).select("tree", F.col("msg").alias("leaf"), "rank", "msg", F.lit(0).cast("long").alias("back"))
    paths = area.table(paths, "paths-0")
    for k in range(len(steps) - 2, -1, -1):
        hop = steps[k].where("up is not null").select("tree", "msg", "up")
        above = paths.join(hop, ["tree", "msg"]).select("tree", "leaf", "rank", F.col("up").alias("msg"), (F.col("back") + (1 << k)).alias("back"))
        paths = area.table(paths.unionByName(above), f"paths-{len(steps) - 1 - k}")
    full = paths.join(base.select("tree", "msg", "conv", "role", "text"), ["tree", "msg"])
    turns = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return full.groupBy("tree", "leaf", "rank").agg(F.first("conv").alias("conv"), turns.alias("turns")).select("conv", "leaf", "rank", "turns")


def format_paths(paths: DataFrame) -> DataFrame:
    """``conv, leaf, rank, formatted, mask``: mask is an array of (start, stop) in code points."""
    kind = dict(paths.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
            mask = pa.array([[{"start": a, "stop": b} for a, b in spans] for _, spans in done], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("leaf"), batch.column("rank"), pa.array([x for x, _ in done], pa.string()), mask], names=["conv", "leaf", "rank", "formatted", "mask"])

    return paths.mapInArrow(run, f"conv {kind}, leaf long, rank int, formatted string, mask array<struct<start:bigint,stop:bigint>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations and their masks."""
    kind = dict(formatted.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[m["start"] : m["stop"]]) for m in mask)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            n, a, b, c, d = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
