"""Transcripts to canonical chat turns: a hidden Markov model finds the roles.

A state is a role and whether the line begins a turn with a marker, without one, or goes on. What a line shows is its
speaker marker, its length and how it ends; what looks like a marker in a line that goes on is content and stays. Transition and emission counts come from a bounded sample of conversations whose roles are known. Roles are the
Viterbi path. A conversation is dealt in chunks of lines: for one with several, each chunk is first reduced to the best score
from every state before it to every state at its end (these compose like matrices), the chunks' states at the edges
follow from these few numbers, and then all chunks are decoded side by side.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sized, stash, table

CHUNK = 1024
#: fixed values: markers that may stand before a turn, by class
MARKERS = (("user", r"(?:user|human|customer|q)\s*[:>]\s?"), ("assistant", r"(?:assistant|ai|bot|a)\s*[:>]\s?"), ("system", r"(?:system|instructions?)\s*[:>]\s?"), ("dash", r"[-*>]\s"))
ANY_MARKER = r"(?i)^\s*(?:" + "|".join(p for _, p in MARKERS) + ")"
_markers = [re.compile(r"(?i)\s*" + p) for _, p in MARKERS]
LENGTHS = (1, 20, 60, 120, 300, 800)
SHOWN = (len(MARKERS) + 1, len(LENGTHS) + 1, 4)


def shown(line: str) -> tuple[int, int, int]:
    marker = next((k for k, p in enumerate(_markers) if p.match(line)), len(_markers))
    return marker, int(np.searchsorted(LENGTHS, len(line), side="right")), {"?": 1, ".": 2}.get(line.rstrip()[-1:], 0 if line.strip() else 3)


@dataclass
class Model:
    roles: list[str]
    start: np.ndarray  # log-probabilities; state 3r begins a turn of role r with a marker, 3r + 1 without, 3r + 2 goes on
    step: np.ndarray
    emit: list[np.ndarray]

    def seen(self, lines: list[str]) -> np.ndarray:
        features = np.array([shown(x or "") for x in lines], int).reshape(-1, len(SHOWN))
        return sum(e[:, features[:, k]] for k, e in enumerate(self.emit)).T

    def matrix(self, seen: np.ndarray, first: bool) -> np.ndarray:
        """Best score of a chunk's lines from each state before it (rows; all alike for the first chunk) to each at its end."""
        best = (np.tile(self.start, (len(self.start), 1)) if first else self.step) + seen[0]
        for e in seen[1:]:
            best = (best[:, :, None] + self.step[None]).max(axis=1) + e
        return best

    def viterbi(self, seen: np.ndarray, before: int | None = None, last: int | None = None) -> list[int]:
        best = (self.start if before is None else self.step[before]) + seen[0]
        back = []
        for e in seen[1:]:
            all_ = best[:, None] + self.step
            back.append(all_.argmax(axis=0))
            best = all_.max(axis=0) + e
        path = [int(best.argmax()) if last is None else last]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def line_key() -> list[str]:
    return ["conv_id", "turn", "line_no"]


def lines_of(conversations: DataFrame, marked: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """conv_id, turn, line_no, line, role, first, marked: a transcript's lines, with ``marked(role, conv_id, turn)`` before each turn's first line."""
    mark = F.coalesce(marked(F.col("role"), F.col("conv_id"), F.col("turn")), F.lit("")) if marked else F.lit("")
    text = F.concat(mark, F.coalesce("text", F.lit("")))
    rows = conversations.select("conv_id", "turn", "role", mark.alias("mark"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("first", F.col("line_no") == 0)
    return rows.withColumn("marked", F.col("first") & (F.col("mark") != "")).drop("mark")


def as_transcribed(role: Column, conv_id: Column, turn: Column) -> Column:
    """How different tools write a turn's speaker, or don't: by a hash of conversation and turn."""
    styles = {"user": ("User: ", "Human: ", "Q: ", "- ", ""), "assistant": ("Assistant: ", "AI: ", "A: ", "- ", ""), "system": ("System: ", "Instructions: ", "System: ", "- ", "")}
    k = F.pmod(F.xxhash64(conv_id, turn), F.lit(5)) + 1
    out = F.lit("")
    for name, ways in styles.items():
        out = F.when(role == name, F.element_at(F.array(*map(F.lit, ways)), k.cast("int"))).otherwise(out)
    return out


def fit(lines: DataFrame, max_conversations: int = 2_000, max_lines: int = 60_000) -> Model | None:
    """Smoothed counts from the least ``max_conversations`` conversations by a hash of conv_id, at most ``max_lines`` of their lines; None without any role."""
    picked = F.broadcast(lines.where("role is not null and conv_id is not null").select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(max_conversations))
    rows = lines.where("role is not null").join(picked, "conv_id").orderBy(F.xxhash64("conv_id"), *line_key()).limit(max_lines).select(*line_key(), "line", "role", "first", "marked").collect()
    roles = sorted({r["role"] for r in rows})
    if not roles:
        return None
    n = 3 * len(roles)
    start, step, emit = np.ones(n), np.full((n, n), 0.1), [np.full((n, k), 0.1) for k in SHOWN]
    last = None
    for r in rows:
        state = 3 * roles.index(r["role"]) + (0 if r["marked"] else 1 if r["first"] else 2)
        if last and last[0] == r["conv_id"]:
            step[last[1], state] += 1
        else:
            start[state] += 1
        for e, v in zip(emit, shown(r["line"]), strict=True):
            e[state, v] += 1
        last = r["conv_id"], state
    emit[0] -= 0.09
    for k, (name, _) in enumerate(MARKERS):
        if name in roles:
            emit[0][3 * roles.index(name), k] += 1
    for state in (1, 2):  # what looks like a marker in content says nothing about the role
        emit[0][state::3] = emit[0][state::3].sum(axis=0)
    start[2::3] = 1e-12
    for k in range(n):  # a turn goes on only with its own role
        step[k, [j for j in range(2, n, 3) if j // 3 != k // 3]] = 1e-12
    return Model(roles, np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), [np.log(e / e.sum(axis=1, keepdims=True)) for e in emit])


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], f: Callable[[pa.Table], dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``f`` over groups whose rows stand together; a group's rows may go over several batches."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        columns = [t.column(k).to_pylist() for k in keys]
        marks = list(zip(*columns, strict=True))
        cuts = [0, *[i for i in range(1, len(marks)) if marks[i] != marks[i - 1]]]
        made = [f(t.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
        if made:
            yield joined(made, schema)
        rest = t.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield joined([f(rest)], schema)


def joined(made: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v for m in made for v in m[f.name]], f.type) for f in schema], schema=schema)


def chunked(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lines`` with ``chunk``, about CHUNK lines each, and the conversations with several. Lines before a turn are counted by turn, and over many turns by group of turns."""
    turns = lines.groupBy("conv_id", "turn").agg((F.max("line_no") + 1).cast("long").alias("n"))
    several = stash(turns.groupBy("conv_id").agg(F.sum("n").alias("n")).where(F.col("n") > CHUNK).select("conv_id"))
    turns = turns.join(sized(several), "conv_id", "left_semi").withColumn("many", F.floor(F.col("turn") / 1024))
    groups = turns.groupBy("conv_id", "many").agg(F.sum("n").alias("all"))
    groups = groups.select("conv_id", "many", (F.sum("all").over(Window.partitionBy("conv_id").orderBy("many")) - F.col("all")).alias("before"))
    own = F.sum("n").over(Window.partitionBy("conv_id", "many").orderBy("turn")) - F.col("n")
    before = stash(turns.withColumn("own", own).join(groups, ["conv_id", "many"]).select("conv_id", "turn", (F.col("before") + F.col("own")).alias("before")))
    chunk = F.coalesce(F.floor((F.col("before") + F.col("line_no")) / CHUNK), F.lit(0)).cast("long")
    return lines.join(sized(before), ["conv_id", "turn"], "left").withColumn("chunk", chunk).drop("before"), several


def roles_of(lines: DataFrame, model: Model | None) -> DataFrame:
    """``lines`` (conv_id, turn, line_no, line) with role, first and marked as the model reads them, by the lines alone."""
    lines, several = chunked(lines.select(*line_key(), "line"))
    if model is None:
        return lines.select(*line_key(), "line", F.lit(None).cast("string").alias("role"), (F.col("line_no") == 0).alias("first"), F.lit(False).alias("marked"), "chunk")
    n = len(model.start)
    side_by_side = lambda df: df.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "line_no")

    def reduce(batches):
        def one(t):
            conv_id, chunk = (t.column(c)[0].as_py() for c in ("conv_id", "chunk"))
            return {"conv_id": [conv_id], "chunk": [chunk], "m": [model.matrix(model.seen(t.column("line").to_pylist()), chunk == 0).ravel().tolist()]}

        yield from runs(batches, ("conv_id", "chunk"), one, pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("m", pa.list_(pa.float64()))]))

    def edges(batches):
        def one(t):
            """The states at the edges of a conversation's chunks. Its first chunk starts anew: any state before it, but by the start's scores."""
            ms = [np.array(m).reshape(n, n) for m in t.column("m").to_pylist()]
            best, back = ms[0][0], []
            for m in ms[1:]:
                all_ = best[:, None] + m
                back.append(all_.argmax(axis=0))
                best = all_.max(axis=0)
            ends = [int(best.argmax())]
            for b in reversed(back):
                ends.append(int(b[ends[-1]]))
            ends = ends[::-1]
            return {"conv_id": t.column("conv_id").to_pylist(), "chunk": t.column("chunk").to_pylist(), "before": [None, *ends[:-1]], "last": ends}

        yield from runs(batches, ("conv_id",), one, pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("before", pa.int32()), ("last", pa.int32())]))

    parts = side_by_side(lines.join(sized(several), "conv_id")).mapInArrow(reduce, "conv_id long, chunk long, m array<double>")
    at_edges = stash(parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(edges, "conv_id long, chunk long, before int, last int"))

    def decode(batches):
        def one(t):
            path = model.viterbi(model.seen(t.column("line").to_pylist()), t.column("before")[0].as_py(), t.column("last")[0].as_py())
            return {**{c: t.column(c).to_pylist() for c in (*line_key(), "line", "chunk")}, "role": [model.roles[s // 3] for s in path], "first": [s % 3 < 2 for s in path], "marked": [s % 3 == 0 for s in path]}

        yield from runs(batches, ("conv_id", "chunk"), one, pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("line_no", pa.int32()), ("line", pa.string()), ("role", pa.string()), ("first", pa.bool_()), ("marked", pa.bool_()), ("chunk", pa.int64())]))

    known = lines.join(sized(at_edges), ["conv_id", "chunk"], "left")
    return side_by_side(known).mapInArrow(decode, "conv_id long, turn long, line_no int, line string, role string, first boolean, marked boolean, chunk long")


def render(lines: DataFrame) -> DataFrame:
    """conv_id, turn_no (from 0), role, n_lines, rendered: the turns that ``roles_of`` found, in canonical form; a marker goes where the model used it as one."""
    starts = lines.groupBy("conv_id", "chunk").agg(F.sum(F.col("first").cast("long")).alias("n"))
    before = starts.select("conv_id", "chunk", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("chunk")) - F.col("n")).alias("before"))
    own = F.sum(F.col("first").cast("long")).over(Window.partitionBy("conv_id", "chunk").orderBy("turn", "line_no"))
    numbered = lines.withColumn("own", own).join(before, ["conv_id", "chunk"]).withColumn("turn_no", F.col("before") + F.col("own") - 1)
    content = F.when(F.col("marked"), F.regexp_replace("line", ANY_MARKER, "")).otherwise(F.col("line"))
    turns = numbered.groupBy("conv_id", "turn_no").agg(F.min_by("role", F.struct("turn", "line_no")).alias("role"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("turn", "line_no", content.alias("line")))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: F.coalesce(x["line"], F.lit(""))), "\n")
    return turns.select("conv_id", "turn_no", "role", "n_lines", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), body, F.lit("\n<|end|>")).alias("rendered"))


def parse(lines: DataFrame, model: Model | None) -> DataFrame:
    """Canonical turns of transcripts: see ``render``.

    ``lines`` has conv_id, turn, line_no (order within a conversation: turn, line_no; in a transcript that is one
    block of text, turn may be the line's number) and line; other columns, a role among them, aren't read. Null lines count
    as empty, as does a null text of a conversation. Rows without conv_id or turn are in no conversation and left out. Rows that repeat are lines that repeat.
    Without a model (no sample with roles) every first line of a turn begins a turn, with role null.
    """
    return render(roles_of(lines.where("conv_id is not null and turn is not null"), model))


def op7_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as transcripts, with markers in several styles or none, and their turns found again."""
    lines = lines_of(table(spark, sf_dir, "conversations"), as_transcribed)
    return parse(lines, fit(lines))

