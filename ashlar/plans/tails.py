"""Feature values at the last rows of each code, with NumPy over blocks of codes.

Spark deals the panel by code and keeps of each code the rows that the values can depend on: an expression says
how far back each of its nodes reads. A task takes the rows in order, some codes at a time, as arrays of
(codes, rows) that end at each code's last row; a node is worked out for the rows that the nodes above it read
and no others, so a window at the last row alone costs one pass over its frame. NULL is NaN here.

Exponential means read as far back as weights are over 1e-17 of the first, so nothing a double can hold is left
out, and what a task holds of a code is bounded whatever the length of its history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .expr import Expr, ewm_rows

#: Panel cells that are worked on at once, and values of window frames that are copied at once.
CELLS, FRAME_VALUES = 1 << 17, 1 << 20
#: Rows of a code whose values are worked out at once where all are asked.
ROWS = 1 << 12


def lookback(op: str, params: tuple) -> int:
    """Rows before its own that a node reads of its operands."""
    if op in ("part", "covar", "list"):
        n = params[-1]
        if n is None:
            raise ValueError(f"{op} over all rows has no bounded look-back")
        return n - 1
    return {"lag": lambda: params[0], "first": lambda: params[0] - 1, "ewm": lambda: ewm_rows(params[0]) - 1}.get(op, lambda: 0)()


class Program:
    """The distinct nodes of some expressions, operands first, with the rows that each is needed for."""

    def __init__(self, exprs: dict[str, Expr], last: int = 1):
        number: dict[str, int] = {}
        self.steps: list[tuple[str, tuple, tuple[int, ...]]] = []
        for root in exprs.values():
            for e in root.walk():
                if e.key not in number:
                    number[e.key] = len(self.steps)
                    self.steps.append((e.op, e.params, tuple(number[a.key] for a in e.args)))
                if e.op not in SCALARS and e.op not in FRAMES and e.op not in ("field", "const"):
                    raise ValueError(f"{e.op} isn't of one code's past")
        self.roots = {name: number[e.key] for name, e in exprs.items()}
        self.rows = [0] * len(self.steps)
        for k in self.roots.values():
            self.rows[k] = last
        self.last_use = list(range(len(self.steps)))
        for k in range(len(self.steps) - 1, -1, -1):
            op, params, args = self.steps[k]
            for a in args:
                self.rows[a] = max(self.rows[a], self.rows[k] + lookback(op, params))
                self.last_use[a] = max(self.last_use[a], k)
        self.reach = max([last, *(n for (op, *_), n in zip(self.steps, self.rows, strict=True) if op == "field")])
        self.fields = sorted({params[0] for op, params, _ in self.steps if op == "field"})
        self.last = last

    def run(self, columns: dict[str, np.ndarray], there: np.ndarray, seen=None) -> dict[str, np.ndarray]:
        """Values (codes, last) of all expressions. there: which cells are rows of a code; they end at the last column.

        seen(k, value, operands) is told the value of each node, in the rows that the nodes above it read.
        """
        values: list = [None] * len(self.steps)
        keep, width = set(self.roots.values()), there.shape[1]
        free: dict[int, list[int]] = {}
        for a, k in enumerate(self.last_use):
            free.setdefault(k, []).append(a)
        with np.errstate(all="ignore"):
            for k, (op, params, args) in enumerate(self.steps):
                rows = min(self.rows[k], width)
                if op == "field":
                    values[k] = columns[params[0]][:, width - rows :]
                elif op == "const":
                    values[k] = np.full((1, 1), params[0])
                elif op in SCALARS:
                    given = [values[a] if values[a].shape[1] == 1 and self.steps[a][0] == "const" else values[a][:, values[a].shape[1] - rows :] for a in args]
                    values[k] = SCALARS[op](*given)
                else:
                    values[k] = FRAMES[op]([values[a] for a in args], params, rows, there)
                if seen is not None:
                    seen(k, values[k], [values[a] for a in args])
                for a in free.get(k, ()):
                    if a not in keep:
                        values[a] = None
        shape = (len(there), min(self.last, width))
        return {name: np.broadcast_to(values[k][:, max(0, values[k].shape[1] - shape[1]) :], shape) for name, k in self.roots.items()}


def known(*x: np.ndarray) -> np.ndarray:
    out = ~np.isnan(x[0])
    for y in x[1:]:
        out = out & ~np.isnan(y)
    return out


def compared(test):
    return lambda a, b: np.where(known(a, b), test(a, b), np.nan)


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """AND of three values."""
    return np.where((a == 0) | (b == 0), 0.0, np.where(known(a, b), 1.0, np.nan))


def either(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """OR of three values."""
    yes = ((a != 0) & known(a)) | ((b != 0) & known(b))
    return np.where(yes, 1.0, np.where(known(a, b), 0.0, np.nan))


def divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.where(b == 0, np.nan, b)


SCALARS = {
    "add": np.add, "sub": np.subtract, "mul": np.multiply, "div": divided, "mod": lambda a, b: a - b * np.floor(divided(a, b)),
    "pow": lambda a, b: np.where(known(a, b), np.power(a, b), np.nan), "neg": np.negative, "abs": np.abs, "sign": np.sign,
    "log": lambda a: np.log(np.where(a > 0, a, np.nan)), "log1p": lambda a: np.log(np.where(a > -1, 1 + a, np.nan)), "exp": np.exp,
    "sqrt": lambda a: np.sqrt(np.where(a >= 0, a, np.nan)), "sqrt0": lambda a: np.sqrt(np.maximum(a, 0)), "max": np.maximum, "min": np.minimum,
    "lt": compared(np.less), "le": compared(np.less_equal), "gt": compared(np.greater), "ge": compared(np.greater_equal), "eq": compared(np.equal), "ne": compared(np.not_equal),
    "and": both, "or": either, "if": lambda c, a, b: np.where((c != 0) & known(c), a, b), "fill": lambda a, b: np.where(known(a), a, b), "known": lambda a: known(a).astype(float),
}


def reaching(x: np.ndarray, rows: int, back: int, there: np.ndarray) -> np.ndarray:
    """The operand's last rows + back columns, NaN where a code has no row."""
    x = np.broadcast_to(x, (len(there), x.shape[1])) if x.shape[1] > 1 else np.broadcast_to(x, (len(there), min(rows + back, there.shape[1])))
    wide = min(x.shape[1], rows + back)
    x = np.where(there[:, there.shape[1] - wide :], x[:, x.shape[1] - wide :], np.nan)
    return x if wide == rows + back else np.concatenate([np.full((len(x), rows + back - wide), np.nan), x], axis=1)


def by_codes(view: np.ndarray, make) -> np.ndarray:
    """make(view) with so many rows of the view at once that copies stay small."""
    each = max(1, FRAME_VALUES // max(1, view.shape[1] * view.shape[2]))
    return np.concatenate([make(view[k : k + each]) for k in range(0, len(view), each)])


def aggregated(kind: str, x: np.ndarray, n: int) -> np.ndarray:
    """An aggregate of the known values in all frames of n columns."""
    ok = known(x)
    total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(ok, axis=1, dtype=float)], axis=1)
    count = total[:, n:] - total[:, :-n]
    if kind == "count":
        return count
    none = np.where(count > 0, 1.0, np.nan)
    if kind in ("max", "min"):
        f, empty = (np.max, -np.inf) if kind == "max" else (np.min, np.inf)
        return f(sliding_window_view(np.where(ok, x, empty), n, axis=1), axis=-1) * 1.0 * none
    filled = np.where(ok, x, 0.0)
    sums = sliding_window_view(filled, n, axis=1).sum(axis=-1)
    if kind == "sum":
        return sums * none
    mean = sums / count
    if kind == "mean":
        return mean
    squares = np.empty_like(mean)
    view, oks = sliding_window_view(filled, n, axis=1), sliding_window_view(ok, n, axis=1)
    each = max(1, FRAME_VALUES // max(1, view.shape[1] * n))
    for k in range(0, len(x), each):
        d = view[k : k + each] - mean[k : k + each, :, None]
        d *= oks[k : k + each]
        squares[k : k + each] = np.einsum("abc,abc->ab", d, d)
    less = 0 if kind == "pstd" else 1
    var = squares / np.where(count > less, count - less, np.nan)
    return var if kind == "var" else np.sqrt(var)


def part(given: list, params: tuple, rows: int, there: np.ndarray) -> np.ndarray:
    kind, n = params
    return aggregated(kind, reaching(given[0], rows, n - 1, there), n)


def covar(given: list, params: tuple, rows: int, there: np.ndarray) -> np.ndarray:
    n = params[0]
    x, y = (reaching(v, rows, n - 1, there) for v in given)
    ok = known(x, y)
    x, y = np.where(ok, x, np.nan), np.where(ok, y, np.nan)
    count = aggregated("count", x, n)
    mx, my = aggregated("mean", x, n), aggregated("mean", y, n)
    out = np.empty_like(mx)
    vx, vy, oks = (sliding_window_view(v, n, axis=1) for v in (np.where(ok, x, 0.0), np.where(ok, y, 0.0), ok))
    each = max(1, FRAME_VALUES // max(1, vx.shape[1] * n))
    for k in range(0, len(x), each):
        s = slice(k, k + each)
        out[s] = np.einsum("abc,abc->ab", (vx[s] - mx[s, :, None]) * oks[s], vy[s] - my[s, :, None])
    return out / np.where(count > 1, count - 1, np.nan)


def lag(given: list, params: tuple, rows: int, there: np.ndarray) -> np.ndarray:
    return reaching(given[0], rows, params[0], there)[:, :rows]


def first(given: list, params: tuple, rows: int, there: np.ndarray) -> np.ndarray:
    """The value k - 1 rows ago, or of a code's first row where it has fewer."""
    back = params[0] - 1
    x = reaching(given[0], rows, back, there)
    start = x.shape[1] - np.minimum(there.sum(axis=1), x.shape[1])
    at = np.maximum(np.arange(rows)[None, :], np.minimum(start[:, None], np.arange(back, back + rows)[None, :]))
    return np.take_along_axis(x, at, axis=1)


def listed(given: list, params: tuple, rows: int, there: np.ndarray) -> np.ndarray:
    """The frames themselves: (codes, rows, n)."""
    return sliding_window_view(reaching(given[0], rows, params[0] - 1, there), params[0], axis=1)


def pick(given: list, params: tuple, rows: int, there: np.ndarray) -> np.ndarray:
    """The p-th smallest known value of each list; NaN sorts last."""
    view, p = given[0][:, given[0].shape[1] - rows :], params[0]
    n = view.shape[2]
    if rows * n > 4 * (rows + n) * (rows + n).bit_length():
        return kth_smallest(np.concatenate([view[:, 0], view[:, 1:, -1]], axis=1), n, p)
    return by_codes(view, lambda v: np.partition(v, p - 1, axis=-1)[..., p - 1])


def kth_smallest(x: np.ndarray, n: int, p: int) -> np.ndarray:
    """The p-th smallest value in all frames of n columns, NaN last, in time that doesn't depend on n.

    Values are numbered by size, and the numbers, in time order, make a wavelet matrix: at each bit, from the highest on, those with a zero
    go first. How many zeros a frame has tells on which side its p-th smallest is, and where the frame stands in the next level.
    """
    codes, width = x.shape
    order = np.argsort(x, axis=1, kind="stable")
    seq = np.empty((codes, width), np.int32)
    places = np.arange(width, dtype=np.int32)
    np.put_along_axis(seq, order, np.broadcast_to(places, seq.shape), axis=1)
    start = np.broadcast_to(places[: width - n + 1], (codes, width - n + 1))
    end, k, rank = start + np.int32(n), np.full(start.shape, p - 1, np.int32), np.zeros(start.shape, np.int32)
    row = np.arange(codes, dtype=np.int32)[:, None] * np.int32(width + 1)
    for level in range(max(1, (width - 1).bit_length()) - 1, -1, -1):
        one = (seq >> level) & 1
        zeros = np.zeros((codes, width + 1), np.int32)
        np.cumsum(1 - one, axis=1, out=zeros[:, 1:])
        total, flat = zeros[:, -1:], zeros.ravel()
        a, b = flat[row + start], flat[row + end]
        left = k < b - a
        rank |= np.where(left, np.int32(0), np.int32(1 << level))
        k = np.where(left, k, k - (b - a))
        start, end = np.where(left, a, total + start - a), np.where(left, b, total + end - b)
        to = np.where(one == 0, zeros[:, :-1], total + places - zeros[:, :-1])
        moved = np.empty_like(seq)
        np.put_along_axis(moved, to, seq, axis=1)
        seq = moved
    return np.take_along_axis(x, np.take_along_axis(order, rank, axis=1), axis=1)


def list_ewm(given: list, params: tuple, rows: int, there: np.ndarray) -> np.ndarray:
    """Exponential mean of the known values of each list."""
    v, keep = given[0][:, given[0].shape[1] - rows :], 1 - params[0]
    total, size = np.zeros(v.shape[:2]), np.zeros(v.shape[:2])
    for k in range(v.shape[2]):
        ok = known(v[..., k])
        total, size = np.where(ok, total * keep + v[..., k], total), size + ok
    return np.where(size > 0, total / ((1 - keep**size) / (1 - keep)), np.nan)


def exponential(given: list, params: tuple, rows: int, there: np.ndarray) -> np.ndarray:
    """Exponentially weighted mean."""
    return divided(*exponential_sums(given[0], params[0], rows, there))


def exponential_sums(x: np.ndarray, alpha: float, rows: int, there: np.ndarray) -> list[np.ndarray]:
    """Weighted sums of the values and of their being known: running sums of growing weights, anew for each block whose weights fit a double."""
    x = reaching(x, rows, min(ewm_rows(alpha) - 1, there.shape[1] - rows), there)
    ok = known(x)
    size = max(1, int(230 / -np.log1p(-alpha)))
    sums = []
    for v in (np.where(ok, x, 0.0), ok.astype(float)):
        out, carried = np.empty_like(v), np.zeros(len(v))
        for k in range(0, v.shape[1], size):
            w = (1 - alpha) ** -np.arange(min(size, v.shape[1] - k), dtype=float)
            out[:, k : k + size] = (np.cumsum(v[:, k : k + size] * w, axis=1) + carried[:, None] * (1 - alpha)) / w
            carried = out[:, min(k + size, v.shape[1]) - 1]
        sums.append(out[:, v.shape[1] - rows :])
    return sums


FRAMES = {"part": part, "covar": covar, "lag": lag, "first": first, "list": listed, "pick": pick, "list_ewm": list_ewm, "ewm": exponential}


def tail_values(panel: DataFrame, exprs: dict[str, Expr], fill: float | None = 0.0, since=None) -> DataFrame:
    """(datetime, code, one column per expression) at the last row of each code, or at all its rows from a time on.

    One exchange on code; of each code as many rows as the values depend on, ranked before and after it.
    """
    last = 1
    if since is not None:
        last = panel.where(F.col("datetime") >= F.lit(since).cast("timestamp_ntz")).groupBy("code").count().agg(F.max("count")).first()[0] or 1
    program = Program(exprs, last)
    names, fields = list(exprs), program.fields
    newest = Window.partitionBy("code").orderBy(F.desc("datetime"))
    # the window leaves each code's rows together, newest first
    given = panel.select("code", "datetime", *[F.col(c).cast("double").alias(c) for c in fields], F.row_number().over(newest).alias("_age")).where(F.col("_age") <= program.reach).sortWithinPartitions("code", F.desc("datetime"))

    def out(held: list[tuple]) -> pa.RecordBatch:
        codes, times = [h[0] for h in held], [h[1] for h in held]
        width = max(len(t) for t in times)
        there, columns = np.zeros((len(held), width), bool), {c: np.full((len(held), width), np.nan) for c in fields}
        for k, (_, t, *cells) in enumerate(held):
            there[k, width - len(t) :] = True
            for c, x in zip(fields, cells, strict=True):
                columns[c][k, width - len(t) :] = x[::-1]
        found = program.run(columns, there)
        rows = min(program.last, width)
        asked = there[:, width - rows :]
        stamps = np.zeros((len(held), rows), "datetime64[us]")
        for k, t in enumerate(times):
            n = min(rows, len(t))
            stamps[k, rows - n :] = t[:n][::-1]
        names_of = np.repeat(np.arange(len(held)), rows).reshape(asked.shape)[asked]
        values = [found[n][asked] for n in names]
        values = [x if fill is None else np.where(np.isnan(x), fill, x) for x in values]
        return pa.RecordBatch.from_arrays([pa.array(stamps[asked]), pa.array(codes, pa.string()).take(pa.array(names_of)), *[pa.array(x, from_pandas=True) for x in values]], ["datetime", "code", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, code, parts, cells = [], None, [], 0

        def close() -> None:
            nonlocal cells
            if parts:
                held.append((code, *(np.concatenate(x) for x in zip(*parts, strict=True))))
                cells += len(held[-1][1])

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("code").to_pandas().to_numpy()
            edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            arrays = [batch.column("datetime").to_numpy(zero_copy_only=False).astype("datetime64[us]"), *(batch.column(c).to_numpy(zero_copy_only=False) for c in fields)]
            for a, b in zip(edges, edges[1:], strict=False):
                if codes[a] != code:
                    close()
                    parts = []
                    if cells >= CELLS:
                        yield out(held)
                        held, cells = [], 0
                    code = codes[a]
                parts.append(tuple(x[a:b] for x in arrays))
        close()
        if held:
            yield out(held)

    schema = ", ".join(["datetime timestamp_ntz, code string", *(f"`{n}` double" for n in names)])
    found = given.drop("_age").mapInArrow(run, schema)
    return found if since is None else found.where(F.col("datetime") >= F.lit(since).cast("timestamp_ntz"))


def all_values(panel: DataFrame, exprs: dict[str, Expr], fill: float | None = 0.0, rows: int = ROWS) -> DataFrame:
    """(datetime, code, one column per expression) at all rows.

    One exchange on code. A task passes each code's rows in order, ``rows`` at a time with as many before them as values
    depend on, so that a code of any length takes bounded memory.
    """
    program = Program(exprs, rows)
    names, fields, back = list(exprs), program.fields, program.reach - rows

    def out(held: list[tuple]) -> pa.RecordBatch:
        """held: (code, times, cells by field, how many of the last rows are asked)."""
        width = max(len(h[1]) for h in held)
        there, columns = np.zeros((len(held), width), bool), {c: np.full((len(held), width), np.nan) for c in fields}
        asked = np.zeros((len(held), width), bool)
        stamps = np.zeros((len(held), width), "datetime64[us]")
        for k, (_, times, cells, n) in enumerate(held):
            there[k, width - len(times) :] = True
            asked[k, width - n :] = True
            stamps[k, width - len(times) :] = times
            for c, x in zip(fields, cells, strict=True):
                columns[c][k, width - len(times) :] = x
        found = program.run(columns, there)
        wide = min(rows, width)
        asked, stamps = asked[:, width - wide :], stamps[:, width - wide :]
        codes = np.repeat(np.arange(len(held)), wide).reshape(asked.shape)[asked]
        values = [x if fill is None else np.where(np.isnan(x), fill, x) for x in (found[n][asked] for n in names)]
        return pa.RecordBatch.from_arrays([pa.array(stamps[asked]), pa.array([h[0] for h in held], pa.string()).take(pa.array(codes)), *[pa.array(x, from_pandas=True) for x in values]], ["datetime", "code", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells, code = [], 0, None
        kept, fresh = None, []  # of the code at hand: rows before, already done; rows to do

        def ready(last: bool) -> Iterator[tuple]:
            """Parts of the code at hand that can be worked out: full ones, and at its end the rest."""
            nonlocal kept, fresh
            if not fresh:
                return
            new = [np.concatenate(x) for x in zip(*fresh, strict=True)]
            at, n = 0, len(new[0])
            while n - at >= rows or (last and at < n):
                m = min(rows, n - at)
                part = [x[at : at + m] for x in new]
                whole = part if kept is None else [np.concatenate(x) for x in zip(kept, part, strict=True)]
                yield code, whole[0], whole[1:], m
                kept, at = [x[len(x) - min(len(x), back) :] for x in whole], at + m
            fresh = [tuple(x[at:] for x in new)] if at < n else []

        def passed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, cells
            for part in ready(last):
                held.append(part)
                cells += len(part[1])
                if cells >= CELLS:
                    yield out(held)
                    held, cells = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column("code").to_pandas().to_numpy()
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            arrays = [batch.column("datetime").to_numpy(zero_copy_only=False).astype("datetime64[us]"), *(batch.column(c).to_numpy(zero_copy_only=False) for c in fields)]
            for a, b in zip(edges, edges[1:], strict=False):
                if of[a] != code:
                    yield from passed(True)
                    code, kept, fresh = of[a], None, []
                fresh.append(tuple(x[a:b] for x in arrays))
                if sum(len(f[0]) for f in fresh) >= rows:
                    yield from passed(False)
        yield from passed(True)
        if held:
            yield out(held)

    schema = ", ".join(["datetime timestamp_ntz, code string", *(f"`{n}` double" for n in names)])
    given = panel.select("code", "datetime", *[F.col(c).cast("double").alias(c) for c in fields]).repartition("code").sortWithinPartitions("code", "datetime")
    return given.mapInArrow(run, schema)
