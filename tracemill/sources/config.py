"""Configuration files of runs."""

from __future__ import annotations

import json
from collections.abc import Sequence


def load_config(path: str, required: Sequence[str] = ()) -> dict:
    """A mapping from a JSON or YAML file (YAML where a parser is installed) that has all required keys."""
    with open(path, encoding="utf-8") as f:
        body = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML parser is installed; use JSON") from e
        data = yaml.safe_load(body)
    else:
        data = json.loads(body)
    if not isinstance(data, dict):
        raise ValueError(f"the configuration must be a mapping: {path}")
    if missing := sorted(k for k in required if k not in data):
        raise ValueError(f"the configuration lacks {', '.join(missing)}: {path}")
    return data
