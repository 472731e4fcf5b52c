"""Processors of feature frames (datetime, code, features): filling, normalising per time, splitting, chains."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("datetime", "code")
TINY = 1e-8
Processor = Callable[[DataFrame], DataFrame]


def numeric(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in KEYS and c not in exclude]


def per_time(df: DataFrame, columns: list[str], make: Callable[[Column, object], Column], group: str = "datetime") -> DataFrame:
    """Replace columns, all by windows over one partitioning."""
    w = Window.partitionBy(group)
    new = {c: make(F.col(f"`{c}`").cast("double"), w).alias(c) for c in columns}
    return df.select(*[new.get(c, F.col(f"`{c}`")) for c in df.columns])


def dropna(subset: list[str] | None = None) -> Processor:
    return lambda df: df.dropna(subset=subset)


def fillna(value: float = 0.0) -> Processor:
    """Null and NaN to a value; infinities stay."""
    fix = lambda c: F.coalesce(F.when(~F.isnan(c), c), F.lit(value))
    return lambda df: df.select(*[fix(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def cs_zscore(exclude: tuple[str, ...] = ()) -> Processor:
    return lambda df: per_time(df, numeric(df, exclude), lambda x, w: (x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + TINY))


def cs_minmax(exclude: tuple[str, ...] = ()) -> Processor:
    return lambda df: per_time(df, numeric(df, exclude), lambda x, w: (x - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w) + TINY))


def cs_rank(exclude: tuple[str, ...] = ()) -> Processor:
    """(average rank / count - 0.5) * 3.46 per time."""
    from ..plans.analysis import average_rank

    return lambda df: per_time(df, numeric(df, exclude), lambda x, w: (average_rank(x, "datetime") / F.count(x).over(w) - 0.5) * 3.46)


def base_name(name: str) -> str:
    """A feature's name without its digits."""
    return "_".join(p for p in (re.sub(r"\d+(min|pct|bp|x)?", "", part) for part in name.split("_")) if p)


def split_mixed(family: list[str]) -> Processor:
    """Columns of a family's base names become ``_ctn`` (0 is missing) and ``_dummy`` (is it not 0?)."""
    names = {base_name(n) for n in family}

    def run(df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            x = F.col(f"`{c}`")
            if c not in KEYS and base_name(c) in names:
                out += [F.when(x != 0, x).alias(f"{c}_ctn"), (x != 0).alias(f"{c}_dummy")]
            else:
                out.append(x)
        return df.select(*out)

    return run


NONLINEAR: dict[str, Callable[[Column, object], Column]] = {
    "sqrt": lambda x, w: F.sqrt(x - F.min(x).over(w)),
    "cube": lambda x, w: F.pow((x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + TINY), 3),
    "exp": lambda x, w: F.exp(F.least(F.greatest((x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + TINY), F.lit(-5.0)), F.lit(5.0))),
}


def nonlinear(transforms: tuple[str, ...] = tuple(NONLINEAR), exclude: tuple[str, ...] = ()) -> Processor:
    """Add transformed columns per time; dummies are left out."""

    def run(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("datetime")
        columns = [c for c in numeric(df, exclude) if not c.endswith("_dummy")]
        return df.select("*", *[NONLINEAR[t](F.col(f"`{c}`"), w).alias(f"{c}_{t}") for c in columns for t in transforms])

    return run


def chain(*processors: Processor) -> Processor:
    def run(df: DataFrame) -> DataFrame:
        for p in processors:
            df = df.transform(p)
        return df

    return run


@dataclass
class FeatureDataHandler:
    """Raw, inference and learning views: shared processors, then those of inference, then those of learning."""

    shared: list[Processor] = field(default_factory=list)
    infer: list[Processor] = field(default_factory=list)
    learn: list[Processor] = field(default_factory=list)

    def fetch(self, df: DataFrame, view: str = "infer") -> DataFrame:
        steps = {"raw": [], "infer": [*self.shared, *self.infer], "learn": [*self.shared, *self.infer, *self.learn]}
        return chain(*steps[view])(df)


def default_handler(norm: str = "zscore") -> FeatureDataHandler:
    """Minute features filled and normalised for inference; rows with gaps dropped for learning."""
    from ..plans.snapshot import minute_features

    norms = {"zscore": cs_zscore, "rank": cs_rank, "minmax": cs_minmax}
    return FeatureDataHandler(shared=[lambda df: minute_features(df, snapshot=False, fill=None)], infer=[fillna(0.0), norms[norm]()], learn=[dropna()])


@dataclass
class FeaturePipeline:
    """Bars to features: compute, optionally normalise one family, fill, save by date."""

    families: tuple[str, ...] | None = None
    fill: float = 0.0

    def process(self, bars: DataFrame, target_date: str | None = None) -> DataFrame:
        """The last row of each code, or with a date all rows of that date."""
        from ..plans.snapshot import minute_features

        if target_date is None:
            return minute_features(bars, self.families, fill=None)
        day = date.fromisoformat(target_date)
        start, end = (datetime(d.year, d.month, d.day) for d in (day, day + timedelta(days=1)))
        return minute_features(bars.where(F.col("datetime") < F.lit(end).cast("timestamp_ntz")), self.families, fill=None, since=start)

    def normalize(self, df: DataFrame, family: str) -> DataFrame:
        from .minute_features import features

        return chain(split_mixed(list(features((family,)))), nonlinear())(df)

    def run(self, bars: DataFrame, normalize: str | None = None, fill: bool = True, target_date: str | None = None) -> DataFrame:
        out = self.process(bars, target_date)
        out = out if normalize is None else self.normalize(out, normalize)
        return fillna(self.fill)(out) if fill else out

    def save(self, df: DataFrame, path: str, start: str | None = None, end: str | None = None, file_format: str = "parquet") -> None:
        from ..sources.readers import DatedSink

        DatedSink(path, file_format).save(df, start, end)
