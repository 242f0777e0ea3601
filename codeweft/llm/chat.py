"""Chat formatting: a finite-state machine over roles and a declarative template.

:func:`format_turns` gives one row a turn: the segments that its text is made of,
each with a loss flag, and whether the machine accepts the conversation so far.
The machine's states are the role last seen; turns go through it in the order of
(turn, role, text). Rows are dealt out in that order by ranges, so one conversation
may be of many tasks: each runs the machine over its part, and what it finds of the
conversation that it begins with is corrected by what the parts before ended with,
one row a part. Only a digest, which can't be made in parts, needs a conversation in
one task; that task hashes what others have parsed.

The template's marks are found again in the output because a backslash before
each mark and each backslash of a text takes away its meaning; :func:`parse` reads
turns back from formatted text.

Defined cases: null texts and roles are empty; a role that the template has no
header for gets the general header and ends acceptance; null conv_ids are one
conversation; equal turn numbers go by role and text, nulls first; repeated rows
are turns of their own; texts and conversations are taken whole, of any length; an
empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Template:
    """Headers by role, the general header's two parts, the end of a turn, the roles under the loss and the machine."""

    headers: tuple[tuple[str, str], ...] = (("system", "### System: "), ("user", "### User: "), ("assistant", "### Assistant: "))
    general: tuple[str, str] = ("### Role ", ": ")
    end: str = " </turn>\n"
    marks: tuple[str, ...] = ("###", "</turn>")
    loss: tuple[str, ...] = ("assistant",)
    #: For each state, the roles that may follow; "" is the start.
    after: tuple[tuple[str, tuple[str, ...]], ...] = (("", ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user",)))
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for mark in self.marks:
            text = text.replace(mark, "\\" + mark)
        return text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of one turn; under the loss is the text alone."""
        header = dict(self.headers).get(role)
        if header is None:
            header = self.general[0] + self.escape(role).replace(":", "\\:") + self.general[1]
        return [(header, False), (self.escape(text), role in self.loss), (self.end, False)]

    def next(self, state: str | None, role: str) -> str | None:
        """The state after ``role``; None once the machine has refused."""
        return role if state is not None and role in dict(self.after).get(state, ()) else None

    def pattern(self) -> re.Pattern:
        if "p" not in self._cache:
            body = r"((?:\\.|(?!%s)[^\\])*?)" % re.escape(self.end)
            heads = "|".join(f"({re.escape(h)})" for _, h in self.headers)
            general = re.escape(self.general[0]) + r"((?:\\.|[^\\:])*)" + re.escape(self.general[1])
            self._cache["p"] = re.compile(f"(?:{heads}|{general}){body}{re.escape(self.end)}", re.S)
        return self._cache["p"]


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(formatted: str, template: Template = Template()) -> list[tuple[str, str]]:
    """The (role, text) turns that ``formatted`` was made of; ValueError if it is no such text."""
    out, at, n = [], 0, len(template.headers)
    for m in template.pattern().finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        named = next((i for i in range(n) if m[i + 1] is not None), None)
        out.append((template.headers[named][0] if named is not None else unescape(m[n + 1]), unescape(m[n + 2])))
    if at != len(formatted):
        raise ValueError(f"not a turn at character {at}")
    return out


SEGMENTS = "array<struct<text: string, loss: boolean>>"


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, position, segments, accepted), a row for each row of ``turns`` (conv_id, turn, role, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, at, first, last, place, state = TaskContext.get().partitionId(), 0, None, object(), 0, None
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                role, text = role or "", text or ""
                if conv != last:
                    last, place = conv, 0
                    lead = at == 0
                    # what came before the first conversation is known to the part before
                    state = role if lead else template.next("", role)
                else:
                    state = template.next(state, role)
                rows.append((conv, part, at, lead, place, role, [{"text": t, "loss": x} for t, x in template.segments(role, text)], state is not None))
                place += 1
                at += 1
            c = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["conv_id", "part", "at", "lead", "place", "role", "segments", "ok"])

    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.substring(F.col("text").cast("string"), 1, 64).alias("head"))
    ranged = rows.repartitionByRange(n, "conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", "turn", "role", "text").drop("head")
    parts = common.written(spark, common.map_arrow(ranged, run, f"conv_id long, part int, at long, lead boolean, place long, role string, segments {SEGMENTS}, ok boolean"), "chat")
    ends = parts.groupBy("part").agg(F.min_by(F.struct("conv_id", "role"), "at").alias("first"), F.max_by(F.struct("conv_id", "role", "place", "lead", "ok"), "at").alias("last"))
    fixes, carry = [], None
    for p in sorted(ends.collect(), key=lambda p: p["part"]):
        first, last = p["first"], p["last"]
        goes_on = carry is not None and carry[0] == first["conv_id"]
        before = carry[1] if goes_on else 0
        ok = carry[3] and template.next(carry[2], first["role"]) is not None if goes_on else template.next("", first["role"]) is not None
        fixes.append((p["part"], before, ok))
        carry = (last["conv_id"], last["place"] + 1 + (before if last["lead"] else 0), last["role"], last["ok"] and (ok or not last["lead"]))
    fixed = parts.join(F.broadcast(spark.createDataFrame(fixes, "part int, before long, first_ok boolean")), "part")
    return fixed.select("conv_id", (F.col("place") + F.when(F.col("lead"), F.col("before")).otherwise(0)).alias("position"), "segments", (F.col("ok") & (F.col("first_ok") | ~F.col("lead"))).alias("accepted"))


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation, read back from its segments by :func:`parse`, turn by turn in order."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            said, loss, chars = [], [], []
            for segments in batch.column(2).to_pylist():
                text = "".join(s["text"] for s in segments)
                said.append([f"{role}\n{own}\n".encode("utf-8", "surrogatepass") for role, own in parse(text, template)])
                loss.append("".join(unescape(s["text"]) for s in segments if s["loss"]))
                chars.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.list_(pa.binary())), pa.array(loss, pa.string()), pa.array(chars, pa.int64()), batch.column(3)], names=["conv_id", "position", "said", "loss", "chars", "accepted"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "accepted"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        now, done = None, []
        for batch in batches:
            for conv, said, loss, chars, accepted in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if now is None or now[0] != conv:
                    if now:
                        done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                for turn in said:
                    now[1] += 1
                    now[2].update(turn)
                now[3] += len(loss)
                now[4].update(loss.encode("utf-8", "surrogatepass"))
                now[5] += chars
                now[6] = accepted
            if len(done) > 1000:
                yield made(done)
                done = []
        if now:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]))
        if done:
            yield made(done)

    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = common.map_arrow(formatted.select("conv_id", "position", "segments", "accepted"), read, "conv_id long, position long, said array<binary>, loss string, chars long, accepted boolean")
    ordered = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "position")
    return common.map_arrow(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, accepted boolean")


#: Texts with every mark of the template in them.
PROBE = "\\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(format_turns(turns))
