"""Layered options: defaults, then a file of ``NAME=value`` lines, then the session, then the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Options:
    """What a deployment may set; every field has a default."""

    batch: int = 25
    keep_runs: int = 24
    daily_searches: int = 20
    daily_calls: int = 400
    least_group: int = 3
    similarity_floor: float = 0.65
    similarity_margin: float = 0.05
    questions: bool = True
    group: str = "combined"


def _read(kind: type, text: str) -> object:
    """A value of a field's kind; a broken one is an error, not the default."""
    if kind is bool:
        if text.strip().lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"no truth value: {text!r}")
        return text.strip().lower() in ("true", "1", "yes")
    return kind(text.strip())


def load(path: str | None = None, spark: SparkSession | None = None, env: Mapping[str, str] | None = None, prefix: str = "QUILLMARK_") -> Options:
    """Options of all layers, the later ones winning; unknown names are ignored, blank and ``#`` lines too."""
    kinds = {f.name: type(f.default) for f in fields(Options)}
    layers: list[dict[str, str]] = []
    if path and Path(path).exists():
        lines = (x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines())
        pairs = (x.split("=", 1) for x in lines if "=" in x and not x.startswith("#"))
        layers.append({k.strip().removeprefix(prefix).lower(): v.strip().strip("\"'") for k, v in pairs})
    if spark is not None:
        layers.append({k: v for k in kinds if (v := spark.conf.get(f"spark.quillmark.{k}", None)) is not None})
    env = os.environ if env is None else env
    layers.append({k.removeprefix(prefix).lower(): v for k, v in env.items() if k.startswith(prefix)})
    out = Options()
    for layer in layers:
        out = replace(out, **{k: _read(kinds[k], v) for k, v in layer.items() if k in kinds})
    return out
