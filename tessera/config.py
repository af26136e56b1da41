"""Engine settings: environment over file or dict over defaults over the caller's default."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

DEFAULTS = {"SEARCH": {"TOP_K": "10", "CONTEXT_BEFORE": "1", "CONTEXT_AFTER": "1"}, "BM25": {"K1": "1.5", "B": "0.75", "DELTA": "1.0"}, "FUSION": {"ALPHA": "0.7"}}


@dataclass
class EngineConfig:
    values: dict[str, dict[str, str]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> EngineConfig:
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yml", ".yaml")):
                import yaml

                raw = yaml.safe_load(f) or {}
            elif path.endswith(".json"):
                raw = json.load(f)
            else:
                raise ValueError(f"Unsupported config type: {path}")
        # only strings count
        return cls({s: {k: v for k, v in kv.items() if isinstance(v, str)} for s, kv in raw.items() if isinstance(kv, dict)})

    def get(self, section: str, key: str, default: str | None = None) -> str | None:
        for name in (f"{section}.{key}", f"{section}_{key}"):  # shells cannot set the dotted form
            if name in os.environ:
                return os.environ[name]
        for values in (self.values, DEFAULTS):
            if (found := values.get(section, {}).get(key)) is not None:
                return found
        return default

    def set(self, section: str, key: str, value: str) -> None:
        self.values.setdefault(section, {})[key] = str(value)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            if path.endswith((".yml", ".yaml")):
                import yaml

                yaml.safe_dump(self.values, f, allow_unicode=True)
            elif path.endswith(".json"):
                json.dump(self.values, f, ensure_ascii=False, indent=2)
            else:
                raise ValueError(f"Unsupported config type: {path}")
