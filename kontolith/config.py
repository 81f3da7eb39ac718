"""Settings of a run: defaults, overridden by a JSON file; an unreadable file leaves the defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    pattern: str = "*.txt"
    profiles: str | None = None
    zero_is_balance: bool = True
    batch: int = 10
    retries: int = 1
    model_enabled: bool = False
    model_url: str = "http://127.0.0.1:11434"
    model_name: str = "phi4-mini"
    model_timeout: int = 180
    #: Batches that are asked for at once; local models answer one at a time.
    model_parallel: int = 1


def load_settings(path: str | None = None) -> Settings:
    if path is None:
        return Settings()
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        return Settings(**{k.name: data[k.name] for k in fields(Settings) if k.name in data})
    except (OSError, ValueError, TypeError):
        return Settings()
