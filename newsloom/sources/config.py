"""Settings of a run from a YAML file."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from newsloom.functions.values import merged_settings


class Settings(Mapping):
    """Nested settings; ``get("lda.n_topics", 50)`` follows dots."""

    def __init__(self, values: Mapping[str, Any]):
        self.values_ = dict(values)

    def __getitem__(self, name: str) -> Any:
        found: Any = self.values_
        for part in name.split("."):
            if not isinstance(found, Mapping) or part not in found:
                raise KeyError(name)
            found = found[part]
        return found

    def __iter__(self):
        return iter(self.values_)

    def __len__(self) -> int:
        return len(self.values_)


def read_settings(path: str, defaults: Mapping[str, Any] | None = None) -> Settings:
    """Settings of a YAML file over the defaults, section by section; the file's win. Needs PyYAML."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML settings needs PyYAML") from missing
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    if not isinstance(found, Mapping):
        raise ValueError(f"{path} holds no sections")
    return Settings(merged_settings(defaults or {}, found))
