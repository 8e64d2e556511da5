"""Chat transcripts: speaker roles recovered by a hidden Markov model.

A transcript is a sequence of lines, some with a speaker marker.  Hidden states are role and
place in the turn (first or later line); the features of a line are its marker and a few
coarse properties.  Probabilities are smoothed counts over labelled transcripts, summed by
Spark.  Viterbi runs in blocks: a block of lines is a matrix of best scores from each state
to each state, the matrices of a transcript are chained, and then every block finds its own
path between the states at its ends.  So a very long transcript is many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import stored

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # 2 * role: first line of a turn, 2 * role + 1: a later line
BLOCK = 1024  # lines
MARKERS = {
    "system": "system|sys|instructions?|instruction",
    "user": "user|human|customer|question|q|you|prompter|me",
    "assistant": "assistant|ai|bot|model|answer|a|agent|gpt|response",
}
_WORDS = "|".join(MARKERS.values())
_MARK = re.compile(rf"^\s*(?:<\|(?:im_start\|>)?\s*({_WORDS})\s*(?:\|>)?|\[({_WORDS})\]:?|#+\s*({_WORDS}):?\s*$|\*{{0,2}}({_WORDS})\*{{0,2}}\s*[:>]\*{{0,2}})[ \t]*", re.I)
_ROLE = {w: i + 1 for i, r in enumerate(ROLES) for w in MARKERS[r].replace("instructions?", "instructions").split("|")}
SHAPES = 5 * 2 * 2  # length class, ends like a question, blank line before


def marker(line: str) -> tuple[int, str]:
    """(0 for none or role + 1, the line without its marker)."""
    found = _MARK.match(line)
    if not found:
        return 0, line
    word = next(g for g in found.groups() if g)
    return _ROLE[word.lower()], line[found.end() :]


def shape(line: str, after_blank: bool) -> int:
    body = line.strip()
    size = min(4, len(body) // 80) if body else 0
    return (size * 2 + body.endswith(("?", "?!", "？"))) * 2 + after_blank


def lines_of(transcripts: DataFrame) -> DataFrame:
    """(conv_id, place, mark, shape, text): the lines of ``transcripts`` (conv_id, part,
    text), whose parts are ordered by ``part``; a part begins a line.

    Null texts are empty.  ``place`` is (part, tie, line) as a sortable struct; rows of one
    part are ordered by a hash of text, label and copy.  Repeated rows are copies with a tie of
    their own each: their lines stay apart and every copy gives its own turns.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                blank = False
                for n, line in enumerate((r.text or "").split("\n")):
                    mark, body = marker(line)
                    rows.append((r.conv_id, r.part, r.tie, n, mark, shape(body, blank), body, r.label))
                    blank = not line.strip()
            yield pd.DataFrame(rows, columns=["conv_id", "part", "tie", "line", "mark", "shape", "text", "label"])

    label = F.col("label") if "label" in transcripts.columns else F.lit(None).cast("int")
    rows = transcripts.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("part").cast("long").alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), label.cast("double").alias("label"),
    )
    # counted first, so that no task holds all copies of a row
    rows = rows.groupBy("conv_id", "part", "text", "label").agg(F.count("*").alias("copies"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).withColumn("tie", F.xxhash64("text", "label", "copy"))
    rows = rows.select("conv_id", "part", "text", "label", "tie")
    return rows.mapInPandas(run, "conv_id long, part long, tie long, line int, mark int, shape int, text string, label double")


def learn(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities from labelled lines (``lines_of`` with the label of each part).

    Counted: markers and shapes by state, and steps between states.  At most states x
    symbols rows reach the driver.  Without rows all is uniform apart from the markers.
    """
    state = F.expr("cast(2 * label + if(line = 0, 0, 1) AS int)")
    rows = labelled.where("label IS NOT NULL").select("conv_id", "part", "tie", "line", "mark", "shape", state.alias("state"))
    marks, shapes = np.ones((STATES, len(ROLES) + 1)), np.ones((STATES, SHAPES))
    for i in range(len(ROLES)):
        marks[2 * i, i + 1] += 20  # a marker speaks for its own role
        marks[2 * i + 1, 0] += 200
    for r in rows.groupBy("state", "mark", "shape").agg(F.count("*").alias("n")).collect():
        marks[r["state"], r["mark"]] += r["n"]
        shapes[r["state"], r["shape"]] += r["n"]
    # the parts of a transcript follow each other: steps by part, then within parts by line
    parts = rows.where("line = 0").select("conv_id", "part", "tie", F.expr("cast(state / 2 AS int)").alias("role"))
    sizes = rows.groupBy("conv_id", "part", "tie").agg(F.max("line").alias("more"))
    # a step is found by the part's number, not by a window over the whole transcript
    after = parts.select("conv_id", (F.col("part") - 1).alias("part"), F.col("role").alias("next")).distinct()
    steps = np.ones((len(ROLES), len(ROLES)))
    for r in parts.join(after, ["conv_id", "part"]).groupBy("role", "next").agg(F.count("*").alias("n")).collect():
        steps[r["role"], r["next"]] += r["n"]
    first = np.ones(len(ROLES))
    begin = parts.where("part = 0").groupBy("role").agg(F.count("*").alias("n")).collect()
    for r in begin:
        first[r["role"]] += r["n"]
    stay = np.ones((len(ROLES), 2))
    for r in parts.join(sizes, ["conv_id", "part", "tie"]).groupBy("role").agg(F.sum("more").alias("more"), F.count("*").alias("n")).collect():
        stay[r["role"]] += (r["more"], r["n"])
    stay /= stay.sum(1, keepdims=True)
    steps /= steps.sum(1, keepdims=True)
    move = np.zeros((STATES, STATES))
    for a in range(STATES):
        role = a // 2
        move[a, 2 * role + 1] = stay[role, 0]
        move[a, 0::2] = stay[role, 1] * steps[role]
    start = np.zeros(STATES)
    start[0::2] = first / first.sum()
    with np.errstate(divide="ignore"):
        return {
            "marks": np.log(marks / marks.sum(1, keepdims=True)), "shapes": np.log(shapes / shapes.sum(1, keepdims=True)),
            "move": np.log(move), "start": np.log(start),
        }


def _emissions(model: dict[str, np.ndarray], marks: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    return model["marks"][:, marks].T + model["shapes"][:, shapes].T


def block_scores(model: dict[str, np.ndarray], emit: np.ndarray) -> np.ndarray:
    """best[a, b]: the best score of the block's lines with ``a`` before it and ``b`` last."""
    best = model["move"] + emit[0]
    for row in emit[1:]:
        best = (best[:, :, None] + model["move"][None]).max(1) + row
    return best


def block_path(model: dict[str, np.ndarray], emit: np.ndarray, before: int, last: int) -> np.ndarray:
    """The best states of a block given the state before it (-1: the transcript begins) and
    its last state; ties go to the smaller state."""
    n = len(emit)
    back = np.zeros((n, STATES), np.int64)
    score = (model["start"] if before < 0 else model["move"][before]) + emit[0]
    for i in range(1, n):
        step = score[:, None] + model["move"]
        back[i] = step.argmax(0)
        score = step.max(0) + emit[i]
    path = np.zeros(n, np.int64)
    path[-1] = last
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def chain(model: dict[str, np.ndarray], matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(state before, last state) of every block of a transcript on its best path.  The
    first block's matrix is one row: the scores of its last states from the start."""
    score, back = matrices[0][0], []
    for m in matrices[1:]:
        step = score[:, None] + m
        back.append(step.argmax(0))
        score = step.max(0)
    last = [int(score.argmax())]
    for b in reversed(back):
        last.append(int(b[last[-1]]))
    last.reverse()
    return list(zip([-1, *last[:-1]], last))


def decode(lines: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``lines`` with ``state``, by Viterbi over each transcript.

    The lines are range-partitioned by transcript and place, so a long transcript is spread
    over tasks; blocks are cut inside these partitions.
    """
    spark = lines.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "part", "tie", "line"]
    schema = lines.schema

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, block, held = None, 0, 0
        first = True
        for batch in batches:
            numbers = np.zeros(len(batch), np.int64)
            for k, own in enumerate(batch["conv_id"].tolist()):
                own = None if own != own else own
                if first or own != conv:
                    conv, block, held, first = own, 0, 0, False
                elif held >= BLOCK:
                    block, held = block + 1, 0
                numbers[k] = block
                held += 1
            yield batch.assign(block=numbers)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    blocked = stored(
        lines.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        .mapInPandas(cut, f"{fields}, block long").withColumn("task", F.spark_partition_id())
    )
    keys = ["conv_id", "task", "block"]

    def runs(group: pd.DataFrame, *more: str) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
        """``group`` in order, and where its transcripts' blocks begin and end."""
        group = group.sort_values(["conv_id", *more], kind="stable").reset_index(drop=True)
        conv = group["conv_id"]
        first = (conv != conv.shift()) & ~(conv.isna() & conv.shift().isna())
        if "block" in more:
            first |= group["block"] != group["block"].shift()
        first.iloc[:1] = True
        edges = np.flatnonzero(first.to_numpy())
        return group, list(zip(edges.tolist(), [*edges[1:].tolist(), len(group)]))

    def matrix(group: pd.DataFrame) -> pd.DataFrame:
        group, blocks = runs(group, "block", "part", "tie", "line")
        every = _emissions(model, group["mark"].to_numpy(), group["shape"].to_numpy())
        inner, begins = [], []
        for x, y in blocks:
            emit = every[x:y]
            inner.append(block_scores(model, emit).ravel().tolist())
            begin = model["start"] + emit[0]
            for row in emit[1:]:
                begin = (begin[:, None] + model["move"]).max(0) + row
            begins.append(begin.tolist())
        return group.loc[[x for x, _ in blocks], keys].assign(inner=inner, begin=begins)

    # a group is a range of lines, as large as the partitions are
    features = blocked.select(*keys, "part", "tie", "line", "mark", "shape")
    scored = features.groupBy("task").applyInPandas(matrix, "conv_id long, task int, block long, inner array<double>, begin array<double>")

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        group, transcripts = runs(group, "task")
        group = group.sort_values(["conv_id", "task", "block"], kind="stable").reset_index(drop=True)
        found = []
        for x, y in transcripts:
            matrices = [np.array(m, float).reshape(STATES, STATES) for m in group["inner"][x:y]]
            matrices[0] = np.array(group["begin"][x], float)[None]
            found += chain(model, matrices)
        return group[keys].assign(before=[b for b, _ in found], last=[e for _, e in found])

    # one row per block of a transcript; a group holds the transcripts of a hash bucket
    bucket = F.pmod(F.xxhash64("conv_id"), F.lit(tasks)).alias("bucket")
    bounds = stored(scored.groupBy(bucket).applyInPandas(ends, "conv_id long, task int, block long, before int, last int"))

    def path(group: pd.DataFrame) -> pd.DataFrame:
        group, blocks = runs(group, "block", "part", "tie", "line")
        every = _emissions(model, group["mark"].to_numpy(), group["shape"].to_numpy())
        before, last = group["before"].to_numpy(), group["last"].to_numpy()
        states = [block_path(model, every[x:y], int(before[x]), int(last[x])) for x, y in blocks]
        return group[[*schema.names]].assign(state=np.concatenate(states))

    same = (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("task") == F.col("t")) & (F.col("block") == F.col("b"))
    own = bounds.select(F.col("conv_id").alias("c"), F.col("task").alias("t"), F.col("block").alias("b"), "before", "last")
    return blocked.join(own, same).drop("c", "t", "b").groupBy("task").applyInPandas(path, f"{fields}, state int")


def turns(decoded: DataFrame) -> DataFrame:
    """(conv_id, part, tie, line, role, text, rendered): recovered turns in canonical form.

    A turn is a line in a first-line state and the later lines after it inside the same
    part; a part that goes on with the turn before it is rendered as a further piece of that
    role.
    """
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.expr("cast(state / 2 AS int) + 1"))
    own = Window.partitionBy("conv_id", "part", "tie").orderBy("line")
    marked = decoded.withColumn("role", role).withColumn(
        "turn", F.sum(F.when((F.col("state") % 2 == 0) | (F.col("line") == 0), 1).otherwise(0)).over(own)
    )
    grouped = marked.groupBy("conv_id", "part", "tie", "turn", "role").agg(
        F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines")
    )
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    return grouped.select(
        "conv_id", "part", "tie", "line", "role", text.alias("text"),
        F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), text, F.lit("<|im_end|>\n")).alias("rendered"),
    )


STYLES = (
    ("System: ", "User: ", "Assistant: "), ("[system] ", "[user] ", "[assistant] "),
    ("<|system|> ", "<|user|> ", "<|assistant|> "), ("**Instructions:** ", "**Human:** ", "**AI:** "),
)


def written(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, text, label): labelled turns as transcript parts, written in one of
    four marker styles, with no marker on about a quarter of the turns."""
    label = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1
    styles = F.array(*[F.array(*map(F.lit, s)) for s in STYLES])
    style = F.element_at(styles, (F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))) + 1).cast("int"))
    label = F.when(label >= 0, label)
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0
    mark = F.when(bare | label.isNull(), F.lit("")).otherwise(F.element_at(style, (label + 1).cast("int")))
    return conversations.select(
        "conv_id", F.col("turn").alias("part"), F.concat(mark, F.coalesce("text", F.lit(""))).alias("text"), label.alias("label")
    )
