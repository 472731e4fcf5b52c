"""Factor registry: metadata, versions, groups and monitoring.

The registry is small metadata. It lives in memory, is saved as one JSON document, and can be read as a
DataFrame. Factors are stored as expression trees in JSON; nothing is pickled.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analysis as an
from .engine import FrequencyConfig
from .expr import Expr, with_factors

STATUSES = ("active", "testing", "deprecated")


def now() -> str:
    return datetime.now(UTC).isoformat()


@dataclass
class FactorMetadata:
    name: str
    description: str
    category: str
    factor_id: str = ""
    author: str = ""
    status: str = "testing"
    tags: list[str] = field(default_factory=list)
    expression: str = ""
    dependencies: list[str] = field(default_factory=list)
    frequencies: list[str] = field(default_factory=list)
    performance: dict[str, dict] = field(default_factory=dict)
    created: str = field(default_factory=now)
    updated: str = field(default_factory=now)

    def __post_init__(self):
        for name in ("name", "description", "category"):
            if not getattr(self, name):
                raise ValueError(f"{name} is required")

    @staticmethod
    def from_dict(d: dict) -> FactorMetadata:
        return FactorMetadata(**{f.name: d[f.name] for f in fields(FactorMetadata) if f.name in d})

    def is_active(self) -> bool:
        return self.status == "active"


def factor_id(factor: Expr, metadata: FactorMetadata) -> str:
    safe = re.sub(r"\W+", "_", metadata.name.strip()).lower()
    return f"{safe}_{hashlib.md5(f'{metadata.name}_{factor}_{metadata.created[:10]}'.encode()).hexdigest()[:8]}"


def parse_version(text: str) -> tuple[int, int, int]:
    m = re.fullmatch(r"v?(\d+)\.(\d+)\.(\d+)", text)
    return tuple(map(int, m.groups())) if m else (1, 0, 0)


def next_version(text: str, kind: str = "minor") -> str:
    a, b, c = parse_version(text)
    return {"major": f"v{a + 1}.0.0", "minor": f"v{a}.{b + 1}.0", "patch": f"v{a}.{b}.{c + 1}"}[kind]


class FactorRegistry:
    """factor_id -> metadata, versions and the current version."""

    def __init__(self, path: str | None = None):
        self.path, self.entries, self.groups = path, {}, {}
        if path and Path(path).exists():
            d = json.loads(Path(path).read_text(encoding="utf-8"))
            self.entries, self.groups = d["factors"], d["groups"]

    def __len__(self): return len(self.entries)
    def __contains__(self, key): return key in self.entries
    def __iter__(self): return iter(self.entries)

    def save(self, path: str | None = None) -> None:
        if target := path or self.path:
            Path(target).parent.mkdir(parents=True, exist_ok=True)
            Path(target).write_text(json.dumps({"factors": self.entries, "groups": self.groups}, ensure_ascii=False, indent=2), encoding="utf-8")

    def register_factor(self, factor: Expr, configs: list[FrequencyConfig], metadata: FactorMetadata) -> str:
        key = metadata.factor_id or factor_id(factor, metadata)
        if key in self.entries:
            raise ValueError(f"{key} is registered")
        metadata.factor_id, metadata.expression, metadata.dependencies = key, str(factor), factor.fields()
        metadata.frequencies = sorted({c.input_freq for c in configs})
        self.entries[key] = {"metadata": asdict(metadata), "versions": {"v1.0.0": version_of(factor, configs, "first version")}, "current": "v1.0.0"}
        self.save()
        return key

    def _entry(self, key: str) -> dict:
        if key not in self.entries:
            raise KeyError(f"no factor {key}")
        return self.entries[key]

    def get_factor(self, key: str, version: str | None = None) -> tuple[Expr, list[FrequencyConfig]]:
        e = self._entry(key)
        v = e["versions"][version or e["current"]]
        return Expr.from_dict(v["factor"]), [FrequencyConfig(**c) for c in v["configs"]]

    def get_metadata(self, key: str) -> FactorMetadata:
        return FactorMetadata.from_dict(self._entry(key)["metadata"])

    def update_metadata(self, key: str, **updates) -> None:
        m = self._entry(key)["metadata"]
        m.update({k: v for k, v in updates.items() if k in m}, updated=now())
        self.save()

    def list_factors(self, category=None, status=None, frequency=None, tags=None) -> list[FactorMetadata]:
        found = [self.get_metadata(k) for k in self.entries]
        ok = lambda m: (category in (None, m.category)) and (status in (None, m.status)) and (frequency is None or frequency in m.frequencies) and (not tags or set(tags) & set(m.tags))
        return sorted(filter(ok, found), key=lambda m: m.created, reverse=True)

    def search_factors(self, keyword: str | None = None, tags=None) -> list[FactorMetadata]:
        word = (keyword or "").lower()
        return [m for m in self.list_factors(tags=tags) if word in m.name.lower() or word in m.description.lower()]

    def delete_factor(self, key: str) -> bool:
        found = self.entries.pop(key, None) is not None
        self.save()
        return found

    def counts(self) -> dict[str, int]:
        by = Counter(e["metadata"]["status"] for e in self.entries.values())
        return {"total": len(self), **{s: by.get(s, 0) for s in STATUSES}}

    def import_registry(self, path: str, merge: bool = True) -> int:
        """Existing factors win in a merge."""
        d = json.loads(Path(path).read_text(encoding="utf-8"))["factors"]
        added = [k for k in d if not merge or k not in self.entries]
        self.entries = d | self.entries if merge else d
        self.save()
        return len(added)

    def as_table(self, spark: SparkSession) -> DataFrame:
        """A row per factor, with tags as an array and performance as a map."""
        rows = [(m.factor_id, m.name, m.category, m.status, m.tags, m.dependencies, m.frequencies, self.entries[m.factor_id]["current"], {k: json.dumps(v) for k, v in m.performance.items()}, m.created) for m in self.list_factors()]
        return spark.createDataFrame(rows, "factor_id string, name string, category string, status string, tags array<string>, dependencies array<string>, frequencies array<string>, version string, performance map<string,string>, created string")

    # versions
    def create_version(self, key: str, factor: Expr, configs: list[FrequencyConfig], changes: str, kind: str = "minor") -> str:
        e = self._entry(key)
        v = next_version(max(e["versions"], key=parse_version), kind)
        e["versions"][v], e["current"] = version_of(factor, configs, changes), v
        e["metadata"] |= {"expression": str(factor), "dependencies": factor.fields(), "updated": now()}
        self.save()
        return v

    def list_versions(self, key: str) -> list[str]: return sorted(self._entry(key)["versions"], key=parse_version, reverse=True)
    def current_version(self, key: str) -> str: return self._entry(key)["current"]

    def version_history(self, key: str) -> list[dict]:
        e = self._entry(key)
        return [{"version": v, "current": v == e["current"], **{k: e["versions"][v][k] for k in ("changes", "created")}} for v in self.list_versions(key)]

    def compare_versions(self, key: str, a: str, b: str) -> dict[str, bool]:
        x, y = (self._entry(key)["versions"][v] for v in (a, b))
        return {"factor_changed": x["factor"] != y["factor"], "configs_changed": x["configs"] != y["configs"]}

    def version_info(self, key: str, version: str | None = None) -> dict:
        """Details of a version, by default of the current one."""
        e = self._entry(key)
        v = version or e["current"]
        if v not in e["versions"]:
            raise KeyError(f"no version {v}")
        held = e["versions"][v]
        return {"factor_id": key, "version": v, "current": v == e["current"], **{k: held[k] for k in ("changes", "created", "configs")}, "expression": str(Expr.from_dict(held["factor"]))}

    def performance_summary(self, key: str) -> dict:
        m = self.get_metadata(key)
        return {"factor_id": key, "name": m.name, "category": m.category, "updated": m.updated, "by_frequency": m.performance}

    def rollback(self, key: str, version: str) -> None:
        e = self._entry(key)
        if version not in e["versions"]:
            raise KeyError(f"no version {version}")
        e["current"] = version
        self.save()

    def delete_version(self, key: str, version: str) -> None:
        e = self._entry(key)
        if version == e["current"]:
            raise ValueError("the current version stays")
        del e["versions"][version]
        self.save()

    # groups
    def create_group(self, name: str, keys: list[str], description: str = "", tags: list[str] | None = None) -> str:
        if missing := [k for k in keys if k not in self.entries]:
            raise KeyError(f"no factors {missing}")
        gid = f"group_{hashlib.md5(name.encode()).hexdigest()[:8]}"
        self.groups[gid] = {"name": name, "factors": list(dict.fromkeys(keys)), "description": description, "tags": tags or [], "created": now()}
        self.save()
        return gid

    def add_to_group(self, gid: str, keys: list[str]) -> None:
        if missing := [k for k in keys if k not in self.entries]:
            raise KeyError(f"no factors {missing}")
        self.groups[gid]["factors"] = list(dict.fromkeys([*self.groups[gid]["factors"], *keys]))
        self.save()

    def remove_from_group(self, gid: str, keys: list[str]) -> None:
        self.groups[gid]["factors"] = [k for k in self.groups[gid]["factors"] if k not in keys]
        self.save()

    def list_groups(self, tag: str | None = None) -> list[dict]:
        return sorted(({"id": k, **g} for k, g in self.groups.items() if tag is None or tag in g["tags"]), key=lambda g: g["created"], reverse=True)

    def group_details(self, gid: str) -> dict:
        g = self.groups[gid]
        return {"id": gid, **g, "factors": [asdict(self.get_metadata(k)) for k in g["factors"] if k in self.entries]}

    def delete_group(self, gid: str) -> bool:
        found = self.groups.pop(gid, None) is not None
        self.save()
        return found

    def group_statistics(self) -> dict:
        sizes = [len(g["factors"]) for g in self.groups.values()]
        return {"groups": len(sizes), "mean_size": sum(sizes) / len(sizes) if sizes else 0.0, "tags": dict(Counter(t for g in self.groups.values() for t in g["tags"]))}


def version_of(factor: Expr, configs: list[FrequencyConfig], changes: str) -> dict:
    return {"factor": factor.to_dict(), "configs": [c.to_dict() for c in configs], "changes": changes, "created": now()}


class FactorMonitor:
    """Evaluates registered factors over a panel (datetime, code, ...)."""

    METRICS = ("ic_mean", "rank_ic_mean", "ic_std", "ir", "coverage")

    def __init__(self, registry: FactorRegistry, least: int = 5):
        self.registry, self.least = registry, least

    def batch_evaluate(self, keys: list[str], panel: DataFrame, ahead: int = 0) -> DataFrame:
        """(factor, ic_mean, rank_ic_mean, ic_std, ir, coverage), best ratio first. All factors in one pass.

        Coefficients are with the return of the same row (ahead=0), or of a later one. Deviations are of the
        population here, and coverage is the share of dates with enough pairs.
        """
        from ..operators.nodes import Close, Ref

        exprs = {k: self.registry.get_factor(k)[0] for k in keys}
        wide = with_factors(panel, exprs | {"return": Close() / Ref(Close(), 1, "rows") - 1}).withColumnsRenamed({"datetime": "timestamp", "code": "asset"})
        wide = an.forward_returns(wide, ahead) if ahead else wide.withColumn("forward", F.col("return"))
        rows = wide.unpivot(["timestamp", "asset", "forward"], keys, "factor", "factor_value")
        pearson = an.daily_ic(rows, "pearson", self.least, ("factor",))
        rank = an.daily_ic(rows, "spearman", self.least, ("factor",)).withColumnRenamed("ic", "rank_ic")
        both = pearson.join(rank, ["factor", "timestamp"])
        out = both.groupBy("factor").agg(F.avg("ic").alias("ic_mean"), F.avg("rank_ic").alias("rank_ic_mean"), F.stddev_pop("ic").alias("ic_std"), F.try_divide(F.avg("ic"), F.stddev_pop("ic")).alias("ir"), F.try_divide(F.count("ic").cast("double"), F.count("*").cast("double")).alias("coverage"))
        return out.orderBy(F.desc_nulls_last("ir"), "factor")

    def evaluate(self, key: str, panel: DataFrame, frequency: str = "daily") -> dict:
        """Metrics of one factor, kept in its metadata."""
        r = self.batch_evaluate([key], panel).first()
        found = {m: r[m] for m in self.METRICS} if r else {}
        self.registry.update_metadata(key, performance=self.registry.get_metadata(key).performance | {frequency: found})
        return found

    def multi_frequency(self, key: str, panels: dict[str, DataFrame]) -> DataFrame:
        """A row of metrics per configuration of the factor, with its frequency's panel."""
        rows = [self.batch_evaluate([key], panels[c.input_freq]).select(F.lit(c.input_freq).alias("frequency"), F.lit(c.window_length).alias("window_length"), "*") for c in self.registry.get_factor(key)[1]]
        return reduce(lambda a, b: a.unionByName(b), rows)

    def detect_decay(self, key: str, panel: DataFrame, days: int = 90, usual: float = 0.05, least_share: float = 0.7) -> dict:
        """Whether the mean IC of the last days is under a share of a usual one."""
        end = panel.agg(F.max("datetime")).first()[0]
        recent = panel.where(F.col("datetime") > F.lit(end).cast("timestamp_ntz") - F.expr(f"interval {days} days"))
        r = self.batch_evaluate([key], recent).first()
        ratio = (r.ic_mean or 0.0) / usual if r else 0.0
        return {"recent_ic": r.ic_mean if r else None, "ratio": ratio, "decayed": ratio < least_share}

    def best_of_group(self, gid: str, panel: DataFrame, metric: str = "ir", top: int = 5) -> DataFrame:
        return self.batch_evaluate(self.registry.groups[gid]["factors"], panel).orderBy(F.desc_nulls_last(metric), "factor").limit(top)

    def compare_groups(self, gids: list[str], panel: DataFrame) -> DataFrame:
        """Mean and best ratio, mean IC and coverage per group, best first."""
        keys = sorted({k for g in gids for k in self.registry.groups[g]["factors"]})
        pairs = panel.sparkSession.createDataFrame([(g, k) for g in gids for k in self.registry.groups[g]["factors"]], "group string, factor string")
        m = self.batch_evaluate(keys, panel).join(pairs, "factor")
        return m.groupBy("group").agg(F.avg("ir").alias("avg_ir"), F.max("ir").alias("best_ir"), F.avg("ic_mean").alias("avg_ic"), F.avg("coverage").alias("avg_coverage")).orderBy(F.desc_nulls_last("avg_ir"), "group")


class FactorLibrary:
    """Registry and monitor together."""

    def __init__(self, path: str | None = None):
        self.registry = FactorRegistry(path)
        self.monitor = FactorMonitor(self.registry)

    def register(self, factor: Expr, configs: list[FrequencyConfig], metadata: FactorMetadata) -> str: return self.registry.register_factor(factor, configs, metadata)
    def get(self, key: str) -> Expr: return self.registry.get_factor(key)[0]
    def list(self, **filters) -> list[FactorMetadata]: return self.registry.list_factors(**filters)
    def evaluate(self, key: str, panel: DataFrame) -> dict: return self.monitor.evaluate(key, panel)
