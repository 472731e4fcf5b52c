"""Feature values bar by bar: what is kept of a code is a vector of fixed length, and a new bar costs that and no more.

Of every node that a window, a lag or a list above it reads, the last values are kept, as many as the longest of these needs, newest
last; of an exponential mean its two sums, which decay by a factor a row. A new row is worked out node by node, each for this one row: a window
over n rows reads n kept values, and nothing is worked out again for rows before. Values are those of ``tails``, whose
functions are used, up to what exponential weights under 1e-17 would add.
"""

from __future__ import annotations

import numpy as np

from .expr import Expr
from .tails import FRAMES, SCALARS, Program, exponential_sums, lookback


class Recurrence:
    """The layout of the vectors and the step from one bar to the next, for many codes at once (codes x size)."""

    def __init__(self, exprs: dict[str, Expr]):
        self.program = Program(exprs)
        self.rings: dict[int, slice] = {}
        self.means: dict[int, int] = {}
        need: dict[int, int] = {}
        for op, params, args in self.program.steps:
            for a in args if op in FRAMES and op not in ("ewm", "pick", "list_ewm") else ():
                need[a] = max(need.get(a, 1), lookback(op, params) + 1)
        at = 1  # the first cell counts the rows so far, up to the longest ring
        for k, n in sorted(need.items()):
            self.rings[k] = slice(at, at + n)
            at += n
        for k, (op, *_) in enumerate(self.program.steps):
            if op == "ewm":
                self.means[k] = at
                at += 2
        self.size, self.longest = at, max([1, *need.values()])
        self.names, self.fields = list(exprs), self.program.fields

    def empty(self, codes: int) -> np.ndarray:
        """Vectors of codes without a row."""
        out = np.full((codes, self.size), np.nan)
        out[:, 0] = 0
        for at in self.means.values():
            out[:, at : at + 2] = 0
        return out

    def built(self, columns: dict[str, np.ndarray], there: np.ndarray) -> np.ndarray:
        """Vectors after the rows of a history (codes x rows, which end at each code's last row)."""
        out = self.empty(len(there))
        out[:, 0] = np.minimum(there.sum(axis=1), self.longest)

        def seen(k: int, value: np.ndarray, operands: list) -> None:
            if k in self.rings:
                ring = self.rings[k]
                n = min(ring.stop - ring.start, there.shape[1])
                value = np.broadcast_to(value, (len(there), max(value.shape[1], n if value.shape[1] == 1 and self.program.steps[k][0] == "const" else 1)))
                n = min(n, value.shape[1])
                out[:, ring.stop - n : ring.stop] = np.where(there[:, there.shape[1] - n :], value[:, value.shape[1] - n :], np.nan)
            if k in self.means:
                at, (alpha,) = self.means[k], self.program.steps[k][1]
                for j, sums in enumerate(exponential_sums(operands[0], alpha, 1, there)):
                    out[:, at + j] = sums[:, -1]

        if there.shape[1]:
            self.program.run(columns, there, seen)
        return out

    def advance(self, held: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Take one more row of each code into the vectors, in place; its values per expression."""
        held[:, 0] = np.minimum(held[:, 0] + 1, self.longest)
        there = np.arange(self.longest) >= self.longest - held[:, :1]
        values: list = [None] * len(self.program.steps)
        with np.errstate(all="ignore"):
            for k, (op, params, args) in enumerate(self.program.steps):
                if op == "field":
                    x = columns[params[0]][:, None]
                elif op == "const":
                    x = np.full((1, 1), params[0])
                elif op in SCALARS:
                    x = SCALARS[op](*[values[a] for a in args])
                elif op == "ewm":
                    at, sums = self.means[k], held[:, self.means[k] : self.means[k] + 2]
                    sums *= 1 - params[0]
                    given = values[args[0]][:, 0]
                    ok = ~np.isnan(given)
                    sums[:, 0] += np.where(ok, given, 0.0)
                    sums[:, 1] += ok
                    x = (held[:, at] / np.where(held[:, at + 1] == 0, np.nan, held[:, at + 1]))[:, None]
                elif op in ("pick", "list_ewm"):
                    x = FRAMES[op]([values[args[0]]], params, 1, there)
                else:
                    x = FRAMES[op]([held[:, self.rings[a]] for a in args], params, 1, there)
                values[k] = x
                if k in self.rings:
                    ring = held[:, self.rings[k]]
                    ring[:, :-1] = ring[:, 1:]
                    ring[:, -1:] = x
        return {name: np.broadcast_to(values[k], (len(held), 1))[:, 0] for name, k in self.program.roots.items()}
