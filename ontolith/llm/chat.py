"""Transcript parsing: turns and speaker roles by a hidden Markov model, then canonical turns.

A transcript is lines of text in which speakers are marked in some style, or not at all; where a turn
begins is not told. The hidden state of a line is a role and whether the line begins a turn, continues it,
or is the gap before it; what is observed of a line is its marker and its shape. The parameters are counts
over conversations with known turns, and Viterbi's algorithm recovers the states.

Lines are sorted by transcript and place into parts of bounded size, which may cut a transcript anywhere.
The algorithm is a product of (max, +) matrices, which is associative: the matrix of each cut transcript
in each part, then the scores before and after it through a tree over the parts, then each part's own
pass, which decodes all its transcripts side by side. No task holds a whole transcript or a whole table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontolith.llm.near import bound_batches
from ontolith.plans.shared import discard, written

ROLES = ("system", "user", "assistant")

# The markers that begin a line, by what they tell.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "prompter"),
    "assistant": ("assistant", "ai", "answer", "a", "bot", "agent", "model"),
}
_MARKED = r"^\s*(?:#{1,4}\s*|\*\*|<\|?|\[)?([A-Za-z]+)(?:\*\*|\|?>|\])?\s*:\s?"
NO_MARKER, BLANK = len(ROLES), len(ROLES) + 1
#: Classes of a line's length in words.
WORDS = (3, 8, 20, 40, 60, 100, 200)
#: What a line can be to a turn; a state is a role and one of these.
BEGINS, CONTINUES, GAP = range(3)
STATES = 3 * len(ROLES)
NEVER = -1e9
#: A transcript doesn't end with a gap.
END = [NEVER if x % 3 == GAP else 0.0 for x in range(STATES)]
#: Lines of a part, and parts that are chained in one place.
PART, FAN = 32_768, 512
FOLDS = 2


def marker_kind(line: Column) -> Column:
    """The role that a line's marker names, as a number; ``NO_MARKER`` for none or an unknown one, ``BLANK`` for a blank line."""
    word = F.lower(F.regexp_extract(line, _MARKED, 1))
    kind = F.when(F.trim(line) == "", BLANK).otherwise(NO_MARKER)
    for i, r in enumerate(ROLES):
        kind = F.when(word.isin(*MARKERS[r]), i).otherwise(kind)
    return kind


def bare(line: Column) -> Column:
    """The line without the marker that ``marker_kind`` knows."""
    return F.when(marker_kind(line) >= NO_MARKER, line).otherwise(F.regexp_replace(line, _MARKED, ""))


def shape(line: Column) -> Column:
    """The class of a line's words."""
    words = F.regexp_count(line, F.lit(r"\S+"))
    return sum((F.when(words > b, 1).otherwise(0) for b in WORDS), F.lit(0))


def observed(lines: DataFrame) -> DataFrame:
    """``lines`` (line, ...) with kind (of the marker), content (without it) and shape."""
    seen = lines.withColumns({"kind": marker_kind(F.col("line")), "content": bare(F.col("line"))})
    return seen.withColumn("shape", shape(F.col("content"))).drop("line")


def fold(conv_id: Column) -> Column:
    return F.pmod(F.xxhash64(conv_id), F.lit(FOLDS)).cast("int")


def train(lines: DataFrame, turns: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities for each fold of transcripts, from those of the other folds.

    ``lines`` are (fold, state, line), ``turns`` (fold, conv_id, turn, first, last): the states that a turn begins and
    ends with. All of them are counted, by Spark; what reaches the driver is one number for each fold and
    pair of states, or state and observation. Of the turns with one number one is counted, the least.
    """
    shapes, k = len(WORDS) + 1, STATES
    look, move, start = np.ones((FOLDS, k, BLANK + 1, shapes)), np.ones((FOLDS, k, k)), np.ones((FOLDS, k))
    for r in observed(lines).groupBy("fold", "state", "kind", "shape").agg(F.count("*").alias("n")).collect():
        for f in range(FOLDS):
            look[f, r["state"], r["kind"], r["shape"]] += r["n"] * (f != r["fold"])
    for r in lines.where("before IS NOT NULL").groupBy("fold", "before", "state").agg(F.count("*").alias("n")).collect():
        for f in range(FOLDS):
            move[f, r["before"], r["state"]] += r["n"] * (f != r["fold"])
    one = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("fold", "conv_id", "turn").agg(F.min(F.struct("first", "last")).alias("x")).select("fold", "conv_id", "turn", "x.*")
    before = one.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("last").alias("before"))
    for r in one.join(before, ["conv_id", "turn"], "left").groupBy("fold", "before", "first").agg(F.count("*").alias("n")).collect():
        for f in range(FOLDS):
            if f != r["fold"]:
                at = (start[f],) if r["before"] is None else (move[f, r["before"]],)
                at[0][r["first"]] += r["n"]
    what, role = np.arange(k) % 3, np.arange(k) // 3
    same = role[:, None] == role[None]
    # A turn continues only its own beginning, and after a gap comes more of it or its beginning.
    well = np.where(what[:, None] == GAP, same & (what[None] != CONTINUES), (what[None] != CONTINUES) | same)
    look[:, what == GAP, :BLANK] = 0
    move, start = move * well, start * (what != CONTINUES)
    logs = lambda x, over: np.log(np.maximum(x / x.sum(axis=over, keepdims=True), 1e-300))
    out = {"start": logs(start, 1), "move": logs(move, 2), "look": logs(look, (2, 3))}
    return {name: np.where(x < -600, NEVER, x) for name, x in out.items()}


def viterbi(model: dict[str, np.ndarray], which: np.ndarray, kind: np.ndarray, shapes: np.ndarray, first: np.ndarray, size: np.ndarray, into: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """Best states of runs of lines, one after the other in the arrays, decoded side by side.

    For each run: its model, whether it begins a transcript, its length, and the scores before it by
    state and after it by its last state. Ties: the first state.
    """
    runs = np.argsort(-size, kind="stable")
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])[runs]
    which, first, size, score, onto = which[runs], first[runs], size[runs], into[runs], onto[runs]
    back, out = np.zeros((len(kind), STATES), np.int8), np.zeros(len(kind), np.int64)
    for t in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -t, side="left"))
        at = begin[:n] + t
        step = model["move"][which[:n]]
        if t == 0:
            step = np.where(first[:n, None, None], model["start"][which[:n]][:, None, :], step)
        through = score[:n, :, None] + step
        back[at] = through.argmax(axis=1)
        score[:n] = through.max(axis=1) + model["look"][which[:n], :, kind[at], shapes[at]]
    last = (score + onto).argmax(axis=1)
    for t in range(int(size.max(initial=0)) - 1, -1, -1):
        n = int(np.searchsorted(-size, -t, side="left"))
        at = begin[:n] + t
        out[at] = last[:n]
        last[:n] = back[at, last[:n]]
    return out


def matrix(model: dict[str, np.ndarray], which: int, kind: np.ndarray, shapes: np.ndarray, first: bool) -> np.ndarray:
    """The (max, +) product of a run's steps: best score from each state to each state."""
    at = None
    for t in range(len(kind)):
        step = (np.broadcast_to(model["start"][which], (STATES, STATES)) if first and t == 0 else model["move"][which]) + model["look"][which, :, kind[t], shapes[t]]
        at = step if at is None else (at[:, :, None] + step[None]).max(axis=1)
    return at


def _grid(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_list()).reshape(len(rows), STATES, STATES)


def _product(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at")
    m = reduce(lambda a, b: (a[:, :, None] + b[None]).max(axis=1), _grid(group["m"]))
    return group[["conv_id", "block"]].head(1).assign(m=[m.reshape(-1)])


def _through(group: pd.DataFrame) -> pd.DataFrame:
    """The scores before and after each matrix of a sequence, given those around the sequence."""
    group = group.sort_values("at")
    each = _grid(group["m"])
    into, onto = [np.array(group["into"].iloc[0])], [np.array(group["onto"].iloc[0])]
    for m in each[:-1]:
        into.append((into[-1][:, None] + m).max(axis=0))
    for m in each[:0:-1]:
        onto.append((m + onto[-1][None]).max(axis=1))
    return group[["conv_id", "at"]].assign(into=into, onto=onto[::-1])


def chained(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """(conv_id, at, m) matrices -> (conv_id, at, into, onto), by a tree in which ``fan`` matrices meet."""
    conv = parts.schema["conv_id"].dataType.simpleString()
    deep = parts.groupBy("conv_id").agg((F.max("at") - F.min("at")).alias("n")).agg(F.max("n")).first()[0] or 0
    if deep < fan:
        held = parts.withColumns({"block": F.lit(0).cast("long"), "into": F.array_repeat(F.lit(0.0), STATES), "onto": F.array(*map(F.lit, END))})
    else:
        blocks = parts.withColumn("block", F.floor(F.col("at") / fan))
        tops = written(blocks.groupBy("conv_id", "block").applyInPandas(_product, f"conv_id {conv}, block long, m array<double>"), "products")
        above = chained(tops.withColumnRenamed("block", "at"), fan).toDF("_c", "_b", "into", "onto")
        held = blocks.join(above, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
    return written(held.groupBy("conv_id", "block").applyInPandas(_through, f"conv_id {conv}, at long, into array<double>, onto array<double>"), "chained")


def _runs(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """A part's lines in order, and where its transcripts begin in them."""
    group = group.sort_values("no", ignore_index=True)
    conv = group["conv_id"]
    same = (conv == conv.shift()) | (conv.isna() & conv.shift().isna())
    same.iloc[0] = False
    return group, np.flatnonzero(~same.to_numpy(bool))


def parse(lines: DataFrame, model: dict[str, np.ndarray], part: int = PART, fan: int = FAN) -> DataFrame:
    """Transcript lines (conv_id, fold, at, line) -> conv_id, turn, piece, role, content, whole.

    ``at`` orders the lines of a transcript. Turns are numbered from 0; a turn that lies in several parts
    has a row, a piece, for each, and ``whole`` marks the last. Gaps are left out of the content. A null conv_id is a transcript like another.
    """
    bound_batches(lines.sparkSession)
    seen = observed(lines)
    parts = max(1, lines.count() // part)
    order = [F.col("conv_id"), F.col("at")]
    seen = seen.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    seen = seen.select("conv_id", "fold", "kind", "shape", "content", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("no"))
    seen = written(seen, "lines")
    conv = seen.schema["conv_id"].dataType.simpleString()
    spans = seen.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").withColumnRenamed("conv_id", "_c")
    spans = written(spans, "spans")
    marked = seen.join(spans, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")

    def products(group: pd.DataFrame) -> pd.DataFrame:
        group, begin = _runs(group)
        out = []
        for a, b in zip(begin, [*begin[1:], len(group)], strict=True):
            r = group.iloc[a]
            m = matrix(model, int(r["fold"]), group["kind"].to_numpy()[a:b], group["shape"].to_numpy()[a:b], bool(r["part"] == r["low"]))
            out.append((r["conv_id"], r["part"], m.reshape(-1)))
        return pd.DataFrame(out, columns=["conv_id", "at", "m"])

    def decoded(group: pd.DataFrame) -> pd.DataFrame:
        group, begin = _runs(group)
        runs, size = group.iloc[begin], np.diff(np.append(begin, len(group)))
        first = (runs["low"].isna() | (runs["low"] == runs["part"])).to_numpy(bool)
        vector = lambda c, none: np.stack([none if x is None else x for x in runs[c]])
        state = viterbi(model, runs["fold"].to_numpy(), group["kind"].to_numpy(), group["shape"].to_numpy(), first, size, vector("into", np.zeros(STATES)), vector("onto", np.array(END)))
        run = np.repeat(np.arange(len(begin)), size)
        begins = np.cumsum(state % 3 == BEGINS)
        nth = begins - np.concatenate([[0], begins])[begin][run]
        text = group.assign(run=run, nth=nth, role=state // 3, gap=state % 3 == GAP)
        text = text[~text["gap"]].groupby(["run", "nth"], sort=True)
        out = text.agg(role=("role", "first"), content=("content", "\n".join)).reset_index()
        out["conv_id"], out["part"] = runs["conv_id"].to_numpy()[out["run"]], group["part"].iloc[0]
        out["begins"] = out.groupby("run")["nth"].transform("max")
        out["on"] = (state[begin] % 3 == CONTINUES)[out["run"]]
        out["spans"] = runs["low"].notna().to_numpy()[out["run"]]
        return out[["conv_id", "part", "nth", "role", "content", "begins", "on", "spans"]]

    mats = marked.where("low IS NOT NULL").groupBy("part").applyInPandas(products, f"conv_id {conv}, at long, m array<double>")
    mats = written(mats, "matrices")
    ends = chained(mats, fan).toDF("_c", "_p", "into", "onto")
    ready = marked.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")), "left").drop("_c", "_p")
    typed = f"conv_id {conv}, part long, nth long, role int, content string, begins long, on boolean, spans boolean"
    pieces = written(ready.groupBy("part").applyInPandas(decoded, typed), "pieces")
    # One row for each part of a cut transcript: turns before it, the part where its first piece's turn began, and whether the next goes on.
    by = Window.partitionBy("_c").orderBy("_p")
    cut = pieces.where("spans").groupBy(F.col("conv_id").alias("_c"), F.col("part").alias("_p")).agg(F.max("begins").alias("b"), F.first("on").alias("on"))
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select("_c", "_p", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("turns"), F.max(F.when(F.col("b") > 0, F.col("_p"))).over(earlier).alias("since"), F.lead("on").over(by).alias("goes_on"))
    out = pieces.drop("on").join(cut, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")), "left")
    turn = F.coalesce("turns", F.lit(0)) + F.col("nth") - 1
    piece = F.when(F.col("nth") > 0, 0).otherwise(F.col("part") - F.coalesce("since", "part"))
    whole = ~((F.col("nth") == F.col("begins")) & F.coalesce("goes_on", F.lit(False)))
    name = F.element_at(F.array(*map(F.lit, ROLES)), F.col("role") + 1)
    out = written(out.select("conv_id", turn.alias("turn"), piece.alias("piece"), name.alias("role"), "content", whole.alias("whole")), "turns")
    discard(seen, spans, mats, pieces)
    return out


def render(turns: DataFrame) -> DataFrame:
    """conv_id, turn, piece, role, content, whole -> the same with rendered for whole: the canonical form, piece by piece."""
    open_, close = F.when(F.col("piece") == 0, F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"))).otherwise(""), F.when(F.col("whole"), "<|im_end|>\n").otherwise("\n")
    return turns.withColumn("rendered", F.concat(open_, "content", close)).drop("whole")


# How transcripts mark the three roles, and what stands between turns; None leaves turns unmarked.
STYLES = (
    (("System: ", "User: ", "Assistant: "), False),
    (("### Instructions: ", "### Human: ", "### Assistant: "), False),
    (("Context: ", "Q: ", "A: "), True),
    (("[system]: ", "[customer]: ", "[agent]: "), True),
    (None, True),
)


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as transcript lines: conv_id, fold, at, line, and what the lines really are.

    Each conversation has a style, by its conv_id. Where blank lines stand between turns, every third
    turn has no marker. Turns of one number are in the order of a hash of their text; null turns come first. Null
    texts are empty lines, and turns of an unknown or null role are never marked.
    """
    style = F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(len(STYLES)))
    mark, gaps = F.lit(""), F.lit(False)
    for i, (names, gap) in enumerate(STYLES):
        gaps = F.when(style == i, gap).otherwise(gaps)
        for role, name in zip(ROLES, names or (), strict=False):
            shown = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) != 0) if gap else F.lit(True)
            mark = F.when((style == i) & (F.col("role") == role) & shown, name).otherwise(mark)
    role = F.lit(None).cast("int")
    for i, r in enumerate(ROLES):
        role = F.when(F.col("role") == r, i).otherwise(role)
    text = F.coalesce("text", F.lit(""))
    told = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text.alias("text"), mark.alias("mark"), gaps.alias("gap"), (3 * role).alias("base"), F.monotonically_increasing_id().alias("row"))
    ls = F.split(F.concat("mark", "text"), "\n", -1)
    told = told.withColumn("ls", F.when(F.col("gap"), F.concat(F.array(F.lit("")), ls)).otherwise(ls)).withColumn("tie", F.xxhash64("text"))
    each = told.select("conv_id", fold(F.col("conv_id")).alias("fold"), "turn", "tie", "row", "base", F.col("gap").cast("int").alias("gap"), F.posexplode("ls").alias("n", "line"))
    what = F.when(F.col("n") < F.col("gap"), GAP).when(F.col("n") == F.col("gap"), BEGINS).otherwise(CONTINUES)
    prior = F.when(F.col("n") == 0, None).when(F.col("n") == F.col("gap"), GAP).when(F.col("n") == F.col("gap") + 1, BEGINS).otherwise(CONTINUES)
    at = F.struct("turn", "tie", "row", "n")
    return each.select("conv_id", "fold", at.alias("at"), "line", (F.col("base") + what).alias("state"), (F.col("base") + prior).alias("before"))


def known_turns(turns: DataFrame) -> DataFrame:
    """(fold, conv_id, turn, first, last) of the turns with known roles, as ``transcripts`` shows them; see ``train``."""
    states = transcripts(turns).where("state IS NOT NULL").groupBy("fold", "conv_id", F.col("at.turn").alias("turn"), F.col("at.tie").alias("tie"), F.col("at.row").alias("row"))
    return states.agg(F.min_by("state", "at").alias("first"), F.max_by("state", "at").alias("last"))


def recover(turns: DataFrame) -> DataFrame:
    """Write conversations as transcripts, recover their turns and roles, and render canonical turns.

    conv_id, turn (recovered, from 0), piece, role (recovered), content, rendered. Transcripts are recovered by a model of
    the conversations in the other fold, so none is read back by what it taught. An empty table gives
    an empty result, and repeated rows are turns of their own. Other columns are ignored.
    """
    lines = transcripts(turns)
    model = train(lines.where("state IS NOT NULL"), known_turns(turns))
    return render(parse(lines.select("conv_id", "fold", "at", "line"), model))


def split(texts: DataFrame) -> DataFrame:
    """Whole transcripts (conv_id, text) as lines for ``parse``; a null text is one empty line."""
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "line")
    return texts.select("conv_id", fold(F.col("conv_id")).alias("fold"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"), lines).select("conv_id", "fold", F.struct("tie", "row", "n").alias("at"), "line")
