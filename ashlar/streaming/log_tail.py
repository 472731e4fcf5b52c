"""Events of log files that still grow, from cuts of their bytes as they land.

A cut is (path, at, data): bytes of a file from a place on. The state of a file is what the lines so far tell of the bar at hand, the half line
at the end, and cuts that came before what stands in front of them; each line is passed once, whatever cuts it came in. Events are
those that ``monitoring.log_events`` finds in the whole files.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .monitoring import BAR, ENDS, LOG_LINES, REASONS, RETRIES, SECONDS, SYMBOLS

EVENT = "path string, line long, type string, bar_time string, cost_seconds double, retry_count int, n_symbols int, reason string"
_PATTERNS = {k: re.compile(p, re.ASCII) for k, p in LOG_LINES.items()}
_TIME = re.compile(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", re.ASCII)
TYPES = {"done": "bar_complete", "first_done": "bar_complete", "written": "bar_complete", "skipped": "abandon", "unfilled": "abandon", "abandoned": "abandon", "exit": "exit"}


def clock(text: str) -> str:
    """HH:MM:SS of a date and time, of HH:MM, HHMM or HHMMSS."""
    digits = text.strip().split(" ")[-1].replace(":", "")[:6].ljust(6, "0")
    return ":".join((digits[:2], digits[2:4], digits[4:]))


def fresh() -> dict:
    """What is known of a bar before its first line."""
    return {"tried": 0, "took": None, "seen": None, "said": None, "at": None}


class FileState:
    """One file: bytes passed, lines passed, the half line, cuts from further on, the bar at hand, and files written before their seconds were known."""

    def __init__(self, held: dict | None = None):
        held = held or {"passed": 0, "line": 0, "half": "", "ahead": {}, "bar": fresh(), "waiting": {}}
        self.passed, self.line, self.bar, self.waiting = held["passed"], held["line"], held["bar"], held["waiting"]
        self.half = base64.b64decode(held["half"])
        self.ahead = {int(k): base64.b64decode(v) for k, v in held["ahead"].items()}

    def to_dict(self) -> dict:
        code = lambda b: base64.b64encode(b).decode()
        return {"passed": self.passed, "line": self.line, "half": code(self.half), "ahead": {k: code(v) for k, v in self.ahead.items()}, "bar": self.bar, "waiting": self.waiting}

    def take(self, at: int, data: bytes) -> Iterator[tuple]:
        """A cut, which may be new, known in part, or from further on; events of the lines that are whole by it."""
        self.ahead[at] = max(data, self.ahead.get(at, b""), key=len)
        while self.ahead and min(self.ahead) <= self.passed:
            start = min(self.ahead)
            new = self.ahead.pop(start)[self.passed - start :]
            self.passed += len(new)
            *lines, self.half = (self.half + new).split(b"\n")
            for text in lines:
                self.line += 1
                yield from self.read(text.decode("utf-8", "replace").removesuffix("\r"))

    def read(self, text: str) -> Iterator[tuple]:
        """Events (line, type, bar_time, cost_seconds, retry_count, n_symbols, reason) that a line ends."""
        kind, m = next(((k, m) for k, p in _PATTERNS.items() if (m := p.search(text))), (None, None))
        if kind is None:
            return
        of = lambda groups, make: make(m[groups[kind]]) if kind in groups else None
        bar, symbols, retries, seconds = of(BAR, clock), of(SYMBOLS, int), of(RETRIES, int), of(SECONDS, float)
        b = self.bar
        if kind == "csv":
            b["tried"] = 0
        if kind in ("fallback_attempt", "retry"):
            b["tried"] = max(b["tried"], retries)
        if kind == "cost":
            b["took"] = seconds
        if kind in ("error", "failed"):
            b["said"] = m[2].strip() if kind == "error" else REASONS["failed"]
        b["seen"] = b["seen"] if symbols is None else symbols
        b["at"] = b["at"] if bar is None else bar
        seen, tried = b["seen"] or 0, b["tried"]
        if kind == "written" and b["took"] is None:
            self.waiting[str(bar)] = [seen, tried]
        elif kind in TYPES:
            done, held = kind in ("done", "first_done"), self.waiting.get(str(bar))
            bars = [clock(t) for t in _TIME.findall(text)] if kind == "unfilled" else [b["at"] or "unknown"] if kind == "abandoned" else [bar]
            cost = seconds if done else b["took"] if kind == "written" else None
            count = 0 if kind in ("first_done", "unfilled") else retries if kind == "abandoned" else held[1] if done and held else None if kind == "exit" else tried
            many = (held[0] if held else seen) if done else seen if kind == "written" else None
            reason = (b["said"] or REASONS[kind]) if kind == "abandoned" else REASONS.get(kind)
            for each in bars:
                yield self.line, TYPES[kind], each, cost, count, many, reason
        if kind in ENDS:
            self.bar = fresh()
            if kind != "written":
                self.waiting = {}


def tail_events(cuts: DataFrame) -> DataFrame:
    """A stream of events from a stream of cuts (path, at, data); cuts may come in any order and again."""

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        file = FileState(json.loads(state.get[0])) if state.exists else FileState()
        rows = [(key[0], *event) for part in parts for at, data in zip(part["at"], part["data"], strict=True) for event in file.take(int(at), bytes(data))]
        state.update((json.dumps(file.to_dict()),))
        columns = [f.split()[0] for f in EVENT.split(", ")]
        yield pd.DataFrame(rows, columns=columns).astype({"retry_count": "Int32", "n_symbols": "Int32", "cost_seconds": "float64"})

    return cuts.select("path", F.col("at").cast("long").alias("at"), "data").groupBy("path").applyInPandasWithState(step, EVENT, "held string", "append", "NoTimeout")
