"""Pairwise alignment with affine gaps, over frames of pairs in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values (Henikoff and Henikoff 1992): BLOSUM62, the half below the diagonal, in the order of the letters.
BLOSUM_LETTERS = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""


def blosum() -> np.ndarray:
    """Scores by the letters' codes; letters outside the matrix score -4."""
    out = np.full((128, 128), -4.0)
    for i, row in enumerate(BLOSUM62.split("\n")[1:-1]):
        for j, value in enumerate(row.split()):
            a, b = ord(BLOSUM_LETTERS[i]), ord(BLOSUM_LETTERS[j])
            out[a, b] = out[b, a] = float(value)
    return out


def align(a: str, b: str, mode: str = "global", protein: bool = False, match: float = 2.0, mismatch: float = -1.0, gap_open: float = -10.0, gap_extend: float = -0.5) -> tuple[float, str, str]:
    """Score and one best alignment; a gap of n letters costs gap_open + (n - 1) * gap_extend, at the ends too in global mode.

    Rows are numpy operations: the horizontal gaps of a row are a running maximum.
    """
    if mode not in ("global", "local"):
        raise ValueError(f"unknown mode {mode!r}: use global or local")
    x, y = (np.frombuffer(s.upper().encode("ascii", "replace"), dtype=np.uint8) for s in (a, b))
    n, m = len(x), len(y)
    matrix = blosum() if protein else None
    best = np.full((n + 1, m + 1), -np.inf)
    down, right = np.full((n + 1, m + 1), -np.inf), np.full((n + 1, m + 1), -np.inf)
    place = np.arange(m + 1)
    best[0, 0] = 0.0
    if mode == "local":
        best[0, :] = 0.0
    else:
        right[0, 1:] = gap_open + gap_extend * (place[1:] - 1)
        best[0, 1:] = right[0, 1:]
    for i in range(1, n + 1):
        score = matrix[x[i - 1], y] if protein else np.where(y == x[i - 1], match, mismatch)
        down[i] = np.maximum(best[i - 1] + gap_open, down[i - 1] + gap_extend)
        row = down[i].copy()
        row[1:] = np.maximum(row[1:], best[i - 1, :-1] + score)
        if mode == "local":
            row = np.maximum(row, 0.0)
        reach = np.maximum.accumulate(row - gap_extend * place)
        right[i, 1:] = reach[:-1] + gap_open + gap_extend * (place[1:] - 1)
        best[i] = np.maximum(row, right[i])
    i, j = (n, m) if mode == "global" else (int(v) for v in np.unravel_index(np.argmax(best), best.shape))
    total, top, low, state = float(best[i, j]), [], [], "best"
    while (i or j) and not (mode == "local" and state == "best" and best[i, j] == 0):
        if state == "best":
            score = (matrix[x[i - 1], y[j - 1]] if protein else match if x[i - 1] == y[j - 1] else mismatch) if i and j else -np.inf
            if i and j and np.isclose(best[i, j], best[i - 1, j - 1] + score):
                i, j = i - 1, j - 1
                top.append(a[i])
                low.append(b[j])
            else:
                state = "down" if i and np.isclose(best[i, j], down[i, j]) else "right"
        elif state == "down":
            if np.isclose(down[i, j], best[i - 1, j] + gap_open):
                state = "best"
            i -= 1
            top.append(a[i])
            low.append("-")
        else:
            if np.isclose(right[i, j], best[i, j - 1] + gap_open):
                state = "best"
            j -= 1
            top.append("-")
            low.append(b[j])
    return total, "".join(reversed(top)).upper(), "".join(reversed(low)).upper()


#: Bytes of traces that pairs aligned together may take; a pair of more goes alone.
TRACES = 1 << 25
DIAGONAL, DOWN, DOWN_OPENS, RIGHT_OPENS, NOTHING = 1, 2, 4, 8, 16


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(x - y) <= 1e-8 + 1e-5 * np.abs(y)


def align_together(a: list[str], b: list[str], mode: str = "global", protein: bool = False, match: float = 2.0, mismatch: float = -1.0, gap_open: float = -10.0, gap_extend: float = -0.5) -> list[tuple[float, str, str]]:
    """What `align` gives, for many pairs in the same rows of numpy arrays, filled up to the longest.

    Scores are kept for two rows only; of every cell a byte tells where the best way to it comes from.
    """
    if mode not in ("global", "local"):
        raise ValueError(f"unknown mode {mode!r}: use global or local")
    own = [[np.frombuffer(s.upper().encode("ascii", "replace"), dtype=np.uint8) for s in side] for side in (a, b)]
    n, m = (np.array([len(x) for x in side]) for side in own)
    count, high, wide = len(a), int(n.max(initial=0)), int(m.max(initial=0))
    x, y = np.zeros((count, high), np.uint8), np.full((count, wide), 1, np.uint8)
    for side, filled in zip(own, (x, y), strict=True):
        for row, letters in zip(filled, side, strict=True):
            row[: len(letters)] = letters
    matrix, place, rows = blosum() if protein else None, np.arange(wide + 1), np.arange(count)
    trace = np.zeros((count, high + 1, wide + 1), np.uint8)
    down, best = np.full((count, wide + 1), -np.inf), np.full((count, wide + 1), -np.inf)
    best[:, 0] = 0.0
    if mode == "local":
        best[:] = 0.0
        trace[:, 0, :] = NOTHING
        top, top_at = np.zeros(count), np.zeros((count, 2), int)
    else:
        best[:, 1:] = gap_open + gap_extend * (place[1:] - 1)
        trace[:, 0, 1] = RIGHT_OPENS
    end = np.where(n == 0, best[rows, m], -np.inf)
    inside = place[None, :] <= m[:, None]
    with np.errstate(invalid="ignore"):
        for i in range(1, high + 1):
            letter = x[:, i - 1 : i]
            score = matrix[letter, y] if protein else np.where(y == letter, match, mismatch)
            opened = best + gap_open
            down = np.maximum(opened, down + gap_extend)
            diagonal = best[:, :-1] + score
            row = down.copy()
            row[:, 1:] = np.maximum(row[:, 1:], diagonal)
            if mode == "local":
                row = np.maximum(row, 0.0)
            reach = np.maximum.accumulate(row - gap_extend * place, axis=1)
            right = np.full_like(row, -np.inf)
            right[:, 1:] = reach[:, :-1] + gap_open + gap_extend * (place[1:] - 1)
            best = np.maximum(row, right)
            code = np.where(near(best, down), DOWN, 0) | np.where(near(down, opened), DOWN_OPENS, 0)
            code[:, 1:] |= np.where(near(best[:, 1:], diagonal), DIAGONAL, 0) | np.where(near(right[:, 1:], best[:, :-1] + gap_open), RIGHT_OPENS, 0)
            if mode == "local":
                code |= np.where(best == 0, NOTHING, 0)
                masked = np.where(inside & (n[:, None] >= i), best, -np.inf)
                at = masked.argmax(axis=1)
                higher = masked[rows, at] > top
                top, top_at[higher] = np.where(higher, masked[rows, at], top), np.stack([np.full(count, i), at], axis=1)[higher]
            trace[:, i] = code
            end = np.where(n == i, best[rows, m], end)
    i, j = (top_at[:, 0].copy(), top_at[:, 1].copy()) if mode == "local" else (n.copy(), m.copy())
    total = top if mode == "local" else end
    state, steps, lengths = np.zeros(count, int), np.zeros((count, high + wide), np.uint8), np.zeros(count, int)  # 0 best, 1 down, 2 right
    while True:
        code = trace[rows, i, j]
        going = (i > 0) | (j > 0)
        if mode == "local":
            going &= ~((state == 0) & ((code & NOTHING) > 0))
        if not going.any():
            break
        diagonal = going & (state == 0) & ((code & DIAGONAL) > 0) & (i > 0) & (j > 0)
        turn = going & (state == 0) & ~diagonal
        state = np.where(turn, np.where((i > 0) & ((code & DOWN) > 0), 1, 2), state)
        down_, right_ = going & (state == 1), going & (state == 2)
        steps[rows[going], lengths[going]] = np.where(diagonal, 0, state)[going]
        lengths += going
        state = np.where((down_ & ((code & DOWN_OPENS) > 0)) | (right_ & ((code & RIGHT_OPENS) > 0)), 0, state)
        i, j = i - (diagonal | down_), j - (diagonal | right_)
    out = []
    for r in range(count):
        way, p, q = steps[r, : lengths[r]][::-1], int(i[r]), int(j[r])
        upper, lower = np.full(len(way), 45, np.uint8), np.full(len(way), 45, np.uint8)
        upper[way != 2], lower[way != 1] = x[r, p : p + int((way != 2).sum())], y[r, q : q + int((way != 1).sum())]
        out.append((float(total[r]), upper.tobytes().decode("ascii"), lower.tobytes().decode("ascii")))
    return out


def align_all(a: list[str], b: list[str], **options) -> list[tuple[float, str, str]]:
    """Alignments in the order of the pairs, made in lots of about equal lengths."""
    order = sorted(range(len(a)), key=lambda r: (len(a[r]), len(b[r])))
    out, at = [None] * len(a), 0
    while at < len(order):
        end, high, wide = at, 0, 0
        while end < len(order):
            high, wide = max(high, len(a[order[end]])), max(wide, len(b[order[end]]))
            if end > at and (end - at + 1) * (high + 1) * (wide + 1) > TRACES:
                break
            end += 1
        for r, made in zip(order[at:end], align_together([a[r] for r in order[at:end]], [b[r] for r in order[at:end]], **options), strict=True):
            out[r] = made
        at = end
    return out


def pairwise(pairs: DataFrame, **options) -> DataFrame:
    """`pair`, `score`, `aligned_a`, `aligned_b` of `pairs(pair, a, b)`; the pairs of an Arrow batch are aligned together."""

    def run(parts):
        for pdf in parts:
            made = align_all(pdf["a"].tolist(), pdf["b"].tolist(), **options)
            yield pd.DataFrame({"pair": pdf["pair"], "score": [m[0] for m in made], "aligned_a": [m[1] for m in made], "aligned_b": [m[2] for m in made]})

    kind = pairs.schema["pair"].dataType.simpleString()
    return pairs.select("pair", "a", "b").mapInPandas(run, f"pair {kind}, score double, aligned_a string, aligned_b string")


def render(aligned_a: str, aligned_b: str, width: int = 60) -> str:
    """Lines of both rows with marks between: | for equal letters, . for unequal ones, a space for gaps."""
    marks = "".join(" " if "-" in (p, q) else "|" if p == q else "." for p, q in zip(aligned_a, aligned_b, strict=True))
    return "\n\n".join("\n".join(s[at : at + width] for s in (aligned_a, marks, aligned_b)) for at in range(0, len(marks), width))
