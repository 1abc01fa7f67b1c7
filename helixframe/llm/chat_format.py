"""Operator 7, chat formatting: a hidden Markov model recovers the speakers of a transcript before turns are rendered.

Every input row is a piece of a conversation's transcript, in order of its number; a piece holds any lines, and nothing
tells where turns begin. States are the roles, each as first line of a turn or as a later line. Lines are observed
through a speaker marker, which may be missing, known or one that tells no role, and three line features. Start,
transition and emission counts come from the rows with a known role, each of which is one turn; Viterbi finds the best
states of each whole conversation, and its turns are rendered in one canonical form.

The lines of a conversation are numbered by sums over blocks of pieces, then over the lines of a block, and cut into
segments of `SEGMENT` lines, so a conversation or a text of any length is spread out. Each segment becomes a max-plus
matrix, the states between segments are solved on those matrices, level by level, at most `FAN` of them in a group, and
the segments are then decoded from their ends. A turn that goes on over a cut is put together again.

Defined results: null numbers come first, in an order by hash; pieces that share a number are in order of their text; a
null text is an empty line; rows with a null conversation are conversations of their own, told apart by their text;
repeated rows are pieces of their own, one after the other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm._shared import materialise

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # a role's first line, then, `len(ROLES)` further on, its later lines
#: Names that mark a role at the start of a line.
MARKERS = {"system": ("system", "instruction", "instructions"), "user": ("user", "human", "customer", "q"), "assistant": ("assistant", "ai", "bot", "model", "agent", "a")}
MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\[|<\|?|\*\*)?(" + "|".join(n for names in MARKERS.values() for n in names) + r")\s*(?:\|?>|\]|\*\*)?\s*(?::|(?<=[>\]])|$)\s*(?:\*\*)?\s*", re.IGNORECASE)
#: What begins a line like a marker but names no role.
ORPHAN = re.compile(r"^\s*(?:>>|\[[^\]\s]{0,12}\]|\w{1,12}(?:\s\d)?:)\s+")
KIND = {n: i + 1 for i, role in enumerate(ROLES) for n in MARKERS[role]}
#: Lines of a segment, segments solved in one group, and piece numbers whose lines are counted in one group.
SEGMENT, FAN, BLOCK = 128, 256, 64
#: Values that each feature can have: marker, length class, question, list or code line.
FEATURES = (len(ROLES) + 2, 4, 2, 2)
BROADCAST_ROWS = 1 << 17


def observe(line: str) -> tuple[tuple[int, ...], str]:
    """Features of a line, and the line without its marker."""
    known = MARKER.match(line)
    found = known or ORPHAN.match(line)
    rest = line[found.end() :] if found else line
    size = len(rest)
    kind = KIND[known[1].lower()] if known else len(ROLES) + 1 if found else 0
    return (kind, (size > 20) + (size > 80) + (size > 200), int(rest.rstrip().endswith("?")), int(rest[:1] in "-*>`|")), rest


def count_lines(pieces: DataFrame) -> DataFrame:
    """`what`, `n`: how often each start, state, feature value and role sequence occurs in rows of known role."""

    def count(parts):
        for pdf in parts:
            found: dict[str, int] = {}
            add = lambda key: found.__setitem__(key, found.get(key, 0) + 1)  # noqa: B023, E731
            for text, role, before, opens in zip(pdf["hf_text"], pdf["hf_role"], pdf["hf_before"], pdf["hf_opens"], strict=True):
                if role not in ROLES:
                    continue
                r = ROLES.index(role)
                if before in ROLES:
                    add(f"turn {ROLES.index(before)} {r}")
                if opens:
                    add(f"start {r}")
                for j, line in enumerate(text.split("\n")):
                    state = r + len(ROLES) * (j > 0)
                    for f, value in enumerate(observe(line)[0]):
                        add(f"line {state} {f} {value}")
            yield pd.DataFrame({"what": list(found), "n": list(found.values())}).astype({"what": "object", "n": "int64"})

    return pieces.mapInPandas(count, "what string, n long").groupBy("what").agg(F.sum("n").alias("n"))


def fit(counts: dict[str, int]) -> dict:
    """Log probabilities: `start`, `move` between states and, for each feature, `emit`; weak priors stand in for what was not counted."""
    n = len(ROLES)
    turn = np.array([[counts.get(f"turn {a} {b}", 0) for b in range(n)] for a in range(n)], float) + np.array([[0.1, 0.8, 0.2], [0.1, 0.1, 0.8], [0.1, 0.8, 0.1]])
    turn /= turn.sum(axis=1, keepdims=True)
    lines = np.array([sum(counts.get(f"line {s} 0 {v}", 0) for v in range(FEATURES[0])) for s in range(STATES)], float)
    stay = ((lines[n:] + 1) / (lines[:n] + lines[n:] + 2))[:, None]  # of a role's lines, those that another of the turn follows
    onward = np.hstack([turn * (1 - stay), np.eye(n) * stay + 1e-12])
    emit = []
    for f, size in enumerate(FEATURES):
        table = np.array([[counts.get(f"line {s} {f} {v}", 0) for v in range(size)] for s in range(STATES)], float)
        prior = np.full((STATES, size), 0.5)
        if f == 0:  # a marker speaks for its role at a turn's start, and for little elsewhere
            prior[:] = 0.02
            prior[:n, 0], prior[n:, 0], prior[:n, -1], prior[n:, -1] = 1.0, 5.0, 0.3, 0.1
            prior[np.arange(n), np.arange(n) + 1] = 4.0
        table += prior
        emit.append(np.log(table / table.sum(axis=1, keepdims=True)))
    first = np.array([counts.get(f"start {r}", 0) for r in range(n)], float) + np.array([0.1, 0.8, 0.1])
    return {"start": np.log(np.concatenate([first / first.sum(), np.full(n, 1e-12)])), "move": np.log(np.vstack([onward, onward])), "emit": emit}


def emissions(features: list[tuple[int, ...]], model: dict) -> np.ndarray:
    values = np.array(features, dtype=int).reshape(-1, len(FEATURES))
    return sum(model["emit"][f][:, values[:, f]].T for f in range(len(FEATURES)))


def step_matrices(emitted: np.ndarray, model: dict, starts: bool) -> list[np.ndarray]:
    """One max-plus matrix a line, from the state before it to its own."""
    steps = [model["move"] + e[None, :] for e in emitted]
    if starts and steps:
        steps[0] = np.repeat((model["start"] + emitted[0])[None, :], STATES, axis=0)
    return steps


def product(steps: list[np.ndarray]) -> np.ndarray:
    out = steps[0]
    for s in steps[1:]:
        out = (out[:, :, None] + s[None, :, :]).max(axis=1)
    return out


def best_path(steps: list[np.ndarray], entry: int = 0, exit_: int = -1) -> list[int]:
    """The best state after each step, from `entry`, and ending in `exit_` if that is given; ties go to the lower state."""
    back, score = [], steps[0][entry]
    for s in steps[1:]:
        options = score[:, None] + s
        back.append(options.argmax(axis=0))
        score = options.max(axis=0)
    path = [int(score.argmax()) if exit_ < 0 else exit_]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def solve(items: DataFrame) -> DataFrame:
    """`hf_conv`, `hf_pos`, `hf_entry`, `hf_exit` of `items(hf_conv, hf_pos, hf_m)`: states before and after each item."""
    schema = "hf_conv string, hf_pos long, hf_entry int, hf_exit int"

    def chain(pdf: pd.DataFrame, entry: int = 0, exit_: int = -1) -> pd.DataFrame:
        pdf = pdf.sort_values("hf_pos")
        path = best_path([np.array(m).reshape(STATES, STATES) for m in pdf["hf_m"]], entry, exit_)
        return pd.DataFrame({"hf_conv": pdf["hf_conv"].to_numpy(), "hf_pos": pdf["hf_pos"].to_numpy(), "hf_entry": [entry, *path[:-1]], "hf_exit": path})

    low, high, n = items.agg(F.min("hf_pos"), F.max("hf_pos"), F.count("*")).first()
    bucket = lambda *keys: F.pmod(F.xxhash64(*keys), F.lit(max(1, n // 1024)))
    each = lambda pdf, keys, f: pd.concat([f(g) for _, g in pdf.groupby(list(keys), sort=False)])
    if low is None or high - low < FAN:
        return items.groupBy(bucket("hf_conv").alias("b")).applyInPandas(lambda pdf: each(pdf, ["hf_conv"], chain), schema)

    def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
        m = product([np.array(x).reshape(STATES, STATES) for x in pdf.sort_values("hf_pos")["hf_m"]])
        return pd.DataFrame({"hf_conv": [pdf["hf_conv"].iloc[0]], "hf_pos": [pdf["hf_up"].iloc[0]], "hf_m": [m.ravel()]})

    keys = ("hf_conv", "hf_up")
    grouped = items.withColumn("hf_up", F.floor(F.col("hf_pos") / FAN))
    upper = grouped.groupBy(bucket(*keys).alias("b")).applyInPandas(lambda pdf: each(pdf, keys, shrink), "hf_conv string, hf_pos long, hf_m array<double>")
    ends = solve(materialise(upper)).withColumnsRenamed({"hf_pos": "hf_up", "hf_entry": "hf_in", "hf_exit": "hf_out"})
    inside = lambda g: chain(g, int(g["hf_in"].iloc[0]), int(g["hf_out"].iloc[0]))
    return grouped.join(ends, list(keys)).groupBy(bucket(*keys).alias("b")).applyInPandas(lambda pdf: each(pdf, keys, inside), schema)


def number_lines(pieces: DataFrame) -> DataFrame:
    """`hf_at`, the place of a piece's first line in its conversation, and `hf_before`, the role of the piece before it in its block."""
    key = ["hf_conv", "hf_block", "hf_salt"]
    placed = pieces.groupBy(*pieces.columns).agg(F.count("*").alias("hf_copies")).withColumns({  # equal rows are placed together, then told apart
        "hf_lines": F.size(F.split("hf_text", "\n")).cast("long"),
        "hf_block": F.floor(F.coalesce("hf_turn", F.lit(-1)) / BLOCK),
        "hf_salt": F.when(F.col("hf_turn").isNull(), F.substring(F.md5("hf_text"), 1, 3)).otherwise(""),
    })
    inside = Window.partitionBy(*key).orderBy("hf_turn", "hf_text", "hf_role")
    placed = materialise(placed.withColumns({"hf_at": F.sum(F.col("hf_lines") * F.col("hf_copies")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("hf_lines") * F.col("hf_copies"), "hf_before": F.lag("hf_role").over(inside)}))
    sums = placed.groupBy(*key).agg(F.sum(F.col("hf_lines") * F.col("hf_copies")).alias("hf_sum"))
    earlier = Window.partitionBy("hf_conv").orderBy("hf_block", "hf_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(sums.select(*key, F.sum("hf_sum").over(earlier).alias("hf_start")).where("hf_start > 0"))
    each = placed.withColumn("hf_copy", F.explode(F.sequence(F.lit(0), F.col("hf_copies") - 1)))
    each = each.withColumns({"hf_at": F.col("hf_at") + F.col("hf_copy") * F.col("hf_lines"), "hf_before": F.when(F.col("hf_copy") > 0, F.col("hf_role")).otherwise(F.col("hf_before"))}).drop("hf_copy", "hf_copies")
    return each.join(bounded(starts), key, "left").withColumn("hf_at", F.col("hf_at") + F.coalesce("hf_start", F.lit(0))).withColumn("hf_opens", F.col("hf_at") == 0).drop("hf_start", "hf_block", "hf_salt")


def bounded(df: DataFrame) -> DataFrame:
    """A hint to broadcast a materialised frame of few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def format_chats(rows: DataFrame, role_of_training: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """conv_id, turn_no, first_line, role, text, rendered: the recovered turns, and the line of its transcript that each begins at.

    `role_of_training` gives the known role of a row that is one whole turn, or null; it is used for counting only, never for decoding.
    """
    spark = rows.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    conv = F.coalesce(F.col(conv_col).cast("string"), F.concat(F.lit("null "), F.sha2(text, 256)))
    pieces = rows.select(F.col(conv_col).cast("string").alias("hf_id"), conv.alias("hf_conv"), F.col(turn_col).cast("long").alias("hf_turn"), text.alias("hf_text"), (F.lit(None).cast("string") if role_of_training is None else role_of_training).alias("hf_role"))
    pieces = number_lines(pieces)
    counts = {r["what"]: r["n"] for r in count_lines(pieces.where(F.col("hf_role").isin(*ROLES))).collect()}
    shared = spark.sparkContext.broadcast(fit(counts))

    # pieces are cut where segments end
    last = F.col("hf_at") + F.col("hf_lines") - 1
    cut = pieces.select("hf_id", "hf_conv", "hf_at", "hf_lines", "hf_text", F.explode(F.sequence(F.floor(F.col("hf_at") / SEGMENT), F.floor(last / SEGMENT))).alias("hf_pos"))
    skip = F.greatest(F.col("hf_pos") * SEGMENT - F.col("hf_at"), F.lit(0))
    end = F.least((F.col("hf_pos") + 1) * SEGMENT - F.col("hf_at"), F.col("hf_lines"))
    own = F.when(F.floor(F.col("hf_at") / SEGMENT) == F.floor(last / SEGMENT), F.col("hf_text")).otherwise(F.array_join(F.slice(F.split("hf_text", "\n"), (skip + 1).cast("int"), (end - skip).cast("int")), "\n"))
    parts = cut.select("hf_id", "hf_conv", "hf_pos", (F.col("hf_at") + skip).alias("hf_at"), own.alias("hf_text"))
    n = pieces.count()
    parts = materialise(parts.withColumn("hf_bucket", F.pmod(F.xxhash64("hf_conv", "hf_pos"), F.lit(max(1, n // 2048)))))
    long = bounded(materialise(parts.where("hf_pos > 0").select("hf_conv").distinct()))

    def segments(pdf: pd.DataFrame):
        """(rows, (line, line without marker) pairs, step matrices) of every segment of a bucket."""
        pdf = pdf.sort_values(["hf_conv", "hf_pos", "hf_at"], kind="stable").reset_index(drop=True)
        ends = np.flatnonzero((pdf["hf_conv"] != pdf["hf_conv"].shift(-1)) | (pdf["hf_pos"] != pdf["hf_pos"].shift(-1))) + 1
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            group = pdf.iloc[start:end]
            lines = [line for t in group["hf_text"] for line in t.split("\n")]
            seen = [observe(line) for line in lines]
            emitted = emissions([features for features, _ in seen], shared.value)
            yield group, [(line, rest) for line, (_, rest) in zip(lines, seen, strict=True)], step_matrices(emitted, shared.value, group["hf_pos"].iat[0] == 0)

    def matrices(pdf: pd.DataFrame) -> pd.DataFrame:
        made = [(group["hf_conv"].iat[0], group["hf_pos"].iat[0], product(steps).ravel()) for group, _, steps in segments(pdf)]
        return pd.DataFrame(made, columns=["hf_conv", "hf_pos", "hf_m"])

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        """The turns of each segment, `no` counting those begun in it from 1; one that goes on from the segment before has 0."""
        made = []
        for group, lines, steps in segments(pdf):
            path = best_path(steps, int(group["hf_entry"].iat[0]), int(group["hf_exit"].iat[0]))
            at, no, fresh = int(group["hf_at"].iat[0]), 0, True
            for i, ((line, rest), state) in enumerate(zip(lines, path, strict=True)):
                opens = state < len(ROLES)
                no += opens
                if opens or fresh:
                    made.append([group["hf_id"].iat[0], group["hf_conv"].iat[0], group["hf_pos"].iat[0], at + i, no, ROLES[state % len(ROLES)], [rest if opens else line]])
                else:
                    made[-1][6].append(line)
                fresh = False
        return pd.DataFrame([(*m[:6], "\n".join(m[6])) for m in made], columns=["hf_id", "hf_conv", "hf_pos", "hf_at", "hf_no", "hf_role", "hf_text"])

    # only conversations of more than one segment need their ends solved; the others start freely and end freely
    ends = solve(materialise(parts.join(long, "hf_conv", "left_semi").groupBy("hf_bucket").applyInPandas(matrices, "hf_conv string, hf_pos long, hf_m array<double>")))
    ready = parts.join(bounded(materialise(ends)), ["hf_conv", "hf_pos"], "left").fillna({"hf_entry": 0, "hf_exit": -1})
    found = materialise(ready.groupBy("hf_bucket").applyInPandas(decode, "hf_id string, hf_conv string, hf_pos long, hf_at long, hf_no long, hf_role string, hf_text string"))
    begun = found.join(long, "hf_conv", "left_semi").groupBy("hf_conv", "hf_pos").agg(F.max("hf_no").alias("n"))
    earlier = Window.partitionBy("hf_conv").orderBy("hf_pos").rowsBetween(Window.unboundedPreceding, -1)
    begun = materialise(begun.select("hf_conv", "hf_pos", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("hf_begun")))
    numbered = found.join(long, "hf_conv", "left_semi").join(bounded(begun), ["hf_conv", "hf_pos"]).withColumn("hf_no", F.col("hf_no") + F.col("hf_begun"))
    whole = numbered.groupBy("hf_id", "hf_conv", "hf_no").agg(F.sort_array(F.collect_list(F.struct("hf_at", "hf_role", "hf_text"))).alias("p"))
    whole = whole.select("hf_id", "hf_no", F.get("p", F.lit(0))["hf_at"].alias("hf_at"), F.get("p", F.lit(0))["hf_role"].alias("hf_role"), F.array_join(F.transform("p", lambda x: x["hf_text"]), "\n").alias("hf_text"))
    turns = found.join(long, "hf_conv", "left_anti").select(*whole.columns).unionByName(whole)
    rendered = F.concat(F.lit("<|"), F.col("hf_role"), F.lit("|>\n"), F.col("hf_text"), F.lit("\n<|end|>"))
    return turns.select(F.col("hf_id").cast(rows.schema[conv_col].dataType).alias(conv_col), (F.col("hf_no") - 1).alias("turn_no"), F.col("hf_at").alias("first_line"), F.col("hf_role").alias("role"), F.col("hf_text").alias("text"), rendered.alias("rendered"))
