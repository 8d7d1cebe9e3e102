"""Raw transcripts to canonical chat turns with a hidden Markov model.

A transcript is a sequence of lines, given as rows (conv_id, part, text) with one line or many in each
text; ``part`` orders them. States are (begins a turn, goes on) for each role. A line is observed as a
speaker marker (its role, an unknown name, or none) and as line features: length, question mark, a list
or code mark, and whether the line before was blank; they are taken as independent given the state.
Viterbi finds the best states. A turn is a first line with what goes on from it; its marker and blank
lines at its ends are dropped, and it is rendered as ``<|im_start|>role\\ntext<|im_end|>``.

**Parameters** are counts over labelled transcripts, summed by Spark. A state that is seen rarely leans
on all states of its kind: their pooled shares count as ``POOLED`` observations more. A small part of
every table is even.

**Long transcripts** are cut into chunks of ``CHUNK`` parts. Each chunk gives the table of best scores
from any state before it to any state at its end, for every line that may stand before it; the tables of
a transcript are joined in order (a few numbers per chunk), and each chunk is then decoded between its
known end states. The result is that of one Viterbi run over the whole, and so are the counts of
:func:`fit`: what lies on two sides of a border is counted from one row per chunk.

Defined results: null and empty texts have no lines; a null part comes first; rows with the same part
are ordered by text, and repeated rows are repeated lines; rows of a null conv_id are one transcript;
an empty table gives no turns. A transcript that starts without a marker gets its most likely role.
Columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.graph import stored

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # 2 * role: begins a turn; 2 * role + 1: goes on
CHUNK, ROWS_PER_TASK = 256, 20_000
POOLED = 20.0
# Shares of a table that are spread evenly, so that what a frequent state never showed costs no more than
# with a rare one: of each feature, and of going on or beginning after a line.
EVEN_FEATURES, EVEN_MOVES = 0.02, 0.1
BEGINNING = 2  # what stands before the first line; otherwise 1 after a blank line, 0 after another

# Words that name a role in front of a line.
ALIASES = {
    "system": 0, "instruction": 0, "instructions": 0, "context": 0,
    "user": 1, "human": 1, "customer": 1, "q": 1, "question": 1, "prompt": 1, "you": 1,
    "assistant": 2, "ai": 2, "bot": 2, "model": 2, "a": 2, "answer": 2, "agent": 2, "gpt": 2, "response": 2,
}
MARKER = re.compile(r"^[\s#>*\-]*(?:\[\s*(\w{1,20})\s*\]|<\|?\s*(\w{1,20})\s*\|?>|(\w{1,20})\s*[:>])[\s*]*", re.ASCII)
MARKS, LENGTHS = 5, 5
FEATURES = {"mark": MARKS, "length": LENGTHS, "question": 2, "list": 2, "after_blank": 3}


def marker(line: str) -> tuple[int, int]:
    """Role of the speaker marker (3 an unknown name, 4 none), and where the text after it begins."""
    found = MARKER.match(line)
    if not found:
        return 4, 0
    name = next(g for g in found.groups() if g)
    return ALIASES.get(name.lower(), 3), found.end()


def observe(lines: list[str], blank: int = BEGINNING) -> np.ndarray:
    """One row of feature values per line; ``blank`` tells what stands before the first one."""
    out = np.empty((len(lines), len(FEATURES)), np.int64)
    for i, line in enumerate(lines):
        bare = line.strip()
        length = 0 if not bare else 1 if len(bare) < 25 else 2 if len(bare) < 80 else 3 if len(bare) < 300 else 4
        listed = bare[:1] in "-*`|" and bool(bare) or bare[:1].isdigit()
        out[i] = marker(line)[0], length, bare.endswith("?"), listed, blank
        blank = int(not bare)
    return out


def lines_of(text: str | None) -> list[str]:
    return text.split("\n") if text else []


class Model:
    """Log probabilities from counts: ``start``, ``move`` (state to state) and one table per feature."""

    def __init__(self, counts: dict[tuple[str, int, int], float] | None = None):
        counts = counts or {}

        def table(name: str, rows: int, columns: int) -> np.ndarray:
            return np.array([[counts.get((name, i, j), 0.0) for j in range(columns)] for i in range(rows)])

        def shares(made: np.ndarray) -> np.ndarray:
            return made / made.sum(axis=-1, keepdims=True)

        with np.errstate(divide="ignore"):
            opening = table("start", 1, STATES)[0] + 1.0
            opening[1::2] = 0.0
            self.start = np.log(shares(opening))
            moves, self.move = table("move", STATES, STATES), np.full((STATES, STATES), -np.inf)
            begins = shares(moves[:, 0::2].sum(axis=0) + 1.0)
            for kind in (0, 1):
                # A line goes on with the role of the line before it, or begins a turn of any role.
                on = np.array([moves[i, 2 * (i // 2) + 1] for i in range(kind, STATES, 2)])
                others = moves[kind::2, 0::2].sum(axis=1)
                stays = (on.sum() + 1.0) / (on.sum() + others.sum() + 2.0)
                for role in range(len(ROLES)):
                    i = 2 * role + kind
                    prior = np.zeros(STATES)
                    prior[0::2], prior[2 * role + 1] = (1 - stays) * begins, stays
                    even = np.zeros(STATES)
                    even[0::2], even[2 * role + 1] = begins / 2, 0.5
                    made = shares(np.where(prior > 0, moves[i], 0.0) + POOLED * prior)
                    self.move[i] = np.log((1 - EVEN_MOVES) * made + EVEN_MOVES * even)
            self.features = []
            for name, n in FEATURES.items():
                seen = table(name, STATES, n)
                pooled = np.stack([shares(seen[i % 2 :: 2].sum(axis=0) + 1.0) for i in range(STATES)])
                if name == "mark":
                    # Of a line that begins a turn, the shares of all speakers' marks go to its own role.
                    named = pooled[::2, : len(ROLES)].sum(axis=1)
                    pooled[::2, : len(ROLES)] = np.diag(named)
                made = shares(seen + POOLED * pooled)
                self.features.append(np.log((1 - EVEN_FEATURES) * made + EVEN_FEATURES / n))

    def emissions(self, lines: list[str], blank: int = BEGINNING) -> np.ndarray:
        seen = observe(lines, blank)
        return sum((t[:, seen[:, i]].T for i, t in enumerate(self.features)), np.zeros((len(lines), STATES)))

    def transfer(self, emissions: np.ndarray, first: bool) -> np.ndarray:
        """Best score from each state before the lines to each state at their end."""
        reach = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
        for i, scores in enumerate(emissions):
            step = np.tile(self.start, (STATES, 1)) if first and i == 0 else self.move
            reach = (reach[:, :, None] + step[None]).max(axis=1) + scores
        return reach

    def decode(self, emissions: np.ndarray, before: int | None, end: int | None) -> list[int]:
        """Best states of the lines from the state before them (None: they start) to the ``end`` state."""
        if not len(emissions):
            return []
        score = (self.start if before is None else self.move[before]) + emissions[0]
        back = []
        for scores in emissions[1:]:
            ways = score[:, None] + self.move
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + scores
        path = [int(score.argmax()) if end is None else end]
        for ways in reversed(back):
            path.append(int(ways[path[-1]]))
        return path[::-1]


def _tasks(rows: DataFrame, *keys: str) -> DataFrame:
    """``task``, a number by which whole (conv_id, chunk) groups share tasks of about ROWS_PER_TASK rows."""
    n = max(1, -(-rows.count() // ROWS_PER_TASK))
    return rows.withColumn("task", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))


def _chunked(transcripts: DataFrame, *more: str) -> DataFrame:
    chunk = F.coalesce(F.floor(F.col("part") / CHUNK), F.lit(-(2**40))).cast("long")
    rows = transcripts.select("conv_id", F.col("part").cast("long").alias("part"), "text", *more)
    return _tasks(rows.withColumn("chunk", chunk), "conv_id", "chunk")


def _each(table: pa.Table, keys: list[str], order: list[str], work: Callable[[tuple, list[dict]], list[dict]], schema: pa.Schema) -> pa.Table:
    """``work`` on the rows of each key of a task, in order."""
    groups: dict[tuple, list[dict]] = {}
    for row in table.sort_by([(c, "ascending") for c in order]).to_pylist():
        groups.setdefault(tuple(row[k] for k in keys), []).append(row)
    made = [r for key, rows in groups.items() for r in work(key, rows)]
    return pa.Table.from_pylist(made, schema)


def fit(labelled: DataFrame) -> Model:
    """A model counted over labelled transcripts (conv_id, part, text, role): one row is one turn."""
    kind = dict(labelled.dtypes)["conv_id"]
    id_type = pa.string() if kind == "string" else pa.int64()
    counts = [("name", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("n", pa.float64())]
    # Edges: first and last state of a chunk, and whether its last line is blank.
    schema = pa.schema([*counts, ("conv_id", id_type), ("chunk", pa.int64()), ("blank", pa.int64())])

    def count(key: tuple, rows: list[dict]) -> list[dict]:
        states, lines = [], []
        for row in rows:
            held = lines_of(row["text"])
            if held and row["role"] in ROLES:
                role = ROLES.index(row["role"])
                lines += held
                states += [2 * role] + [2 * role + 1] * (len(held) - 1)
        if not lines:
            return []
        seen = observe(lines)
        pairs = [("move", a, b) for a, b in zip(states, states[1:])]
        for k, name in enumerate(FEATURES):
            skip = int(name == "after_blank")
            pairs += [(name, s, int(v)) for s, v in zip(states[skip:], seen[skip:, k])]
        edge = {"name": "edge", "i": states[0], "j": states[-1], "n": 1.0, "conv_id": key[0], "chunk": key[1], "blank": int(not lines[-1].strip())}
        return [edge, *({"name": a, "i": i, "j": j, "n": 1.0} for a, i, j in pairs)]

    def run(table: pa.Table) -> pa.Table:
        made = _each(table, ["conv_id", "chunk"], ["conv_id", "chunk", "part", "text"], count, schema)
        keys = [c for c in schema.names if c != "n"]
        return made.group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"]).select(schema.names)

    form = f"name string, i long, j long, n double, conv_id {kind}, chunk long, blank long"
    counted = stored(_chunked(labelled, "role").groupBy("task").applyInArrow(run, form), "counts")
    before = Window.partitionBy("conv_id").orderBy("chunk")
    edges = counted.where("name = 'edge'").select(
        "i", F.lag("j").over(before).alias("last"), F.coalesce(F.lag("blank").over(before), F.lit(BEGINNING)).alias("blank")
    )
    opening = F.struct(
        F.when(F.col("last").isNull(), "start").otherwise("move").alias("name"), F.coalesce("last", F.lit(0)).cast("long").alias("i"), F.col("i").alias("j")
    )
    met = F.struct(F.lit("after_blank").alias("name"), F.col("i").alias("i"), F.col("blank").cast("long").alias("j"))
    borders = edges.select(F.inline(F.array(opening, met))).withColumn("n", F.lit(1.0))
    whole = counted.where("name <> 'edge'").select("name", "i", "j", "n").unionByName(borders)
    rows = whole.groupBy("name", "i", "j").agg(F.sum("n").alias("n")).collect()
    return Model({(r["name"], r["i"], r["j"]): r["n"] for r in rows})


def parse(transcripts: DataFrame, model: Model) -> DataFrame:
    """conv_id, turn (from 0), role, text, n_lines, rendered: the turns of all transcripts."""
    shared = transcripts.sparkSession.sparkContext.broadcast(model)
    chunked = stored(_chunked(transcripts), "chunks")
    kind = dict(transcripts.dtypes)["conv_id"]
    order = ["conv_id", "chunk", "part", "text"]
    id_type = pa.string() if kind == "string" else pa.int64()

    def text_lines(rows: list[dict]) -> list[str]:
        return [line for row in rows for line in lines_of(row["text"])]

    tables = pa.schema([("conv_id", id_type), ("chunk", pa.int64()), ("blank", pa.int32()), ("last", pa.int32()), ("scores", pa.list_(pa.float64()))])

    def transfers(table: pa.Table) -> pa.Table:
        def work(key: tuple, rows: list[dict]) -> list[dict]:
            lines = text_lines(rows)
            if not lines:
                return [{"conv_id": key[0], "chunk": key[1]}]
            last, emissions, made = int(not lines[-1].strip()), shared.value.emissions(lines), []
            for blank in (0, 1, BEGINNING):
                emissions[0] = shared.value.emissions(lines[:1], blank)[0]
                scores = shared.value.transfer(emissions, blank == BEGINNING)
                made.append({"conv_id": key[0], "chunk": key[1], "blank": blank, "last": last, "scores": scores.ravel().tolist()})
            return made

        return _each(table, ["conv_id", "chunk"], order, work, tables)

    ends = pa.schema([("conv_id", id_type), ("chunk", pa.int64()), ("blank", pa.int32()), ("before", pa.int32()), ("end", pa.int32())])

    def join_chunks(table: pa.Table) -> pa.Table:
        def work(key: tuple, rows: list[dict]) -> list[dict]:
            held = {(r["chunk"], r["blank"]): r for r in rows if r["scores"] is not None}
            blank, score, steps = BEGINNING, np.zeros(STATES), []
            for chunk in sorted({c for c, _ in held}):
                row = held[(chunk, blank)]
                scores = np.array(row["scores"]).reshape(STATES, STATES)
                ways = scores[:1] if blank == BEGINNING else score[:, None] + scores
                steps.append((chunk, blank, None if blank == BEGINNING else ways.argmax(axis=0)))
                score, blank = ways.max(axis=0), row["last"]
            state, out = int(score.argmax()), []
            for chunk, blank, back in reversed(steps):
                before = None if back is None else int(back[state])
                out.append({"conv_id": key[0], "chunk": chunk, "blank": blank, "before": before, "end": state})
                state = before
            return out

        return _each(table, ["conv_id"], ["conv_id", "chunk"], work, ends)

    found = chunked.groupBy("task").applyInArrow(transfers, f"conv_id {kind}, chunk long, blank int, last int, scores array<double>")
    joined = _tasks(stored(found, "transfers"), "conv_id").groupBy("task").applyInArrow(
        join_chunks, f"conv_id {kind}, chunk long, blank int, before int, end int"
    )
    known = joined.withColumnsRenamed({"conv_id": "_conv", "chunk": "_chunk"})
    met = chunked.join(known, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")))
    pieces = pa.schema([("conv_id", id_type), ("chunk", pa.int64()), ("local", pa.int64()), ("role", pa.string()), ("lines", pa.list_(pa.string()))])

    def turns(table: pa.Table) -> pa.Table:
        def work(key: tuple, rows: list[dict]) -> list[dict]:
            lines = text_lines(rows)
            path = shared.value.decode(shared.value.emissions(lines, rows[0]["blank"]), rows[0]["before"], rows[0]["end"])
            out: list[dict] = []
            begun = 0
            for line, state in zip(lines, path):
                begins = state % 2 == 0
                begun += begins
                if begins or not out:
                    out.append({"conv_id": key[0], "chunk": key[1], "local": begun, "role": ROLES[state // 2] if begins else None, "lines": []})
                    line = line[marker(line)[1] :] if begins and marker(line)[0] < 3 else line
                out[-1]["lines"].append(line)
            return out

        return _each(table, ["conv_id", "chunk"], order, work, pieces)

    parts = stored(met.groupBy("task").applyInArrow(turns, f"conv_id {kind}, chunk long, local long, role string, lines array<string>"), "turns")
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy("conv_id", "chunk").agg(F.max("local").alias("begun"))
    bases = bases.select(
        F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("base")
    )
    placed = parts.join(bases, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")))
    placed = placed.withColumn("turn", F.col("base") + F.col("local") - 1)
    whole = placed.groupBy("conv_id", "turn").agg(
        F.max("role").alias("role"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "lines"))), lambda x: x["lines"])).alias("lines")
    )
    text = F.regexp_replace(F.array_join("lines", "\n"), r"^\s*\n|\s+$", "")
    rendered = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    return whole.select("conv_id", "turn", "role", text.alias("text"), F.size("lines").alias("n_lines")).withColumn("rendered", rendered)
