"""Settings of jobs: files that must have a known form, names of the environment, mirrors. Small values of the driver, no tables."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import TypeVar

T = TypeVar("T")
#: What an evaluation by judges must state, how many criteria it has, and how far off 1 their weights may be together.
JUDGED = ("dataset_path", "selection_ids_path", "output_dir", "evaluation_size", "seed", "model", "adapters", "generation_config", "judge_api", "criteria")
CRITERIA, OFF = 5, 1e-9


def load(path: str) -> dict:
    """A mapping from a JSON file, or from a YAML file where a reader for it is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        value = json.loads(text)
    else:
        import yaml

        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError(f"no mapping in {path}")
    return value


def for_stage(settings: dict, stage: str, version: str) -> dict:
    """The settings, if they are of this version and for this stage."""
    for key, wanted in (("schema_version", version), ("stage", stage)):
        if settings.get(key) != wanted:
            raise ValueError(f"{key} is {settings.get(key)!r}, not {wanted!r}")
    return settings


def for_judges(settings: dict) -> dict:
    """The settings, if they state all that an evaluation by judges needs and its numbers fit together."""
    criteria, generation = settings.get("criteria") or {}, settings.get("generation_config") or {}
    off = abs(sum(float(c["weight"]) for c in criteria.values()) - 1) if isinstance(criteria, dict) else 1
    sampled = bool(generation.get("do_sample"))
    complaints = [
        *(f"{k} is missing" for k in JUDGED if k not in settings),
        *([f"{len(criteria)} criteria, not {CRITERIA}"] if len(criteria) != CRITERIA else []),
        *(["the weights don't sum to 1"] if off > OFF else []),
        *(f"{k} is needed where answers are sampled" for k in ("temperature", "top_p") if sampled and generation.get(k) is None),
        *(f"{k} must be positive" for k in ("max_new_tokens", "batch_size") if int(generation.get(k) or 0) <= 0),
    ]
    if complaints:
        raise ValueError("; ".join(complaints))
    return settings


def first_set(names: str | Iterable[str] | None) -> str | None:
    """The value of the first variable of the environment that is set and not empty."""
    wanted = [names] if isinstance(names, str) else list(names or [])
    return next((value for name in wanted if (value := os.environ.get(str(name)))), None)


def mirrored(url: str, mirror: str) -> str:
    """The address below a mirror; itself without one."""
    return "/".join([mirror.strip().rstrip("/"), url]) if mirror.strip() else url


def retried(step: Callable[[], T], tries: int, fatal: Callable[[Exception], bool], wait: Callable[[float], None] = time.sleep) -> T:
    """What step gives, tried again after pauses of 1, 2, 4 and so on seconds; a fatal error, or the last one, is passed on."""
    for n in range(max(1, tries)):
        try:
            return step()
        except Exception as error:
            if fatal(error) or n + 1 >= tries:
                raise
            wait(2.0**n)
    raise AssertionError("unreachable")
