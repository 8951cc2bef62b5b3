"""Settings: nested dictionaries with dotted overrides, and the defaults of a run."""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any

#: What a run without settings of its own goes by.
DEFAULTS: dict[str, Any] = {
    "seed": 42,
    "snapshot_date": "2026-09-17",
    "start_date": "2020-01-01",
    "window_days": 119,
    "splits": {"train": ["2020-01-01", "2024-12-31"], "val": ["2025-01-01", "2025-12-31"], "test": ["2026-01-01", None]},
    "labels": {"top_k": 15, "min_count": 3},
    "placeholders": ["NVD-CWE-Other", "NVD-CWE-noinfo"],
    "filter": {"require_english_description": True, "exclude_rejected": True, "single_label_only": True},
    "dedup": {"drop_train_exact_duplicates": True, "drop_train_overlap_with_eval": True, "drop_val_overlap_with_test": True},
    "export": {"max_chars": 1500, "sampling": "natural", "train_max": None, "val_max": None, "test_max": None, "per_class": None},
}


def scalar(text: str) -> Any:
    """A value as YAML types it: null, booleans, numbers, lists and maps in JSON's form, else the string itself."""
    words = {"null": None, "~": None, "": None, "true": True, "false": False}
    if text.strip().lower() in words:
        return words[text.strip().lower()]
    try:
        return json.loads(text)
    except ValueError:
        return text.strip().strip("'\"")


def load(path: str | Path | None = None, overrides: list[str] = (), base: dict[str, Any] | None = None) -> dict[str, Any]:
    """The defaults, then a YAML or JSON file whose root is a mapping, then overrides `a.b=value`."""
    out = copy.deepcopy(DEFAULTS if base is None else base)
    if path is not None:
        text = Path(path).read_text(encoding="utf-8")
        try:
            import yaml

            loaded = yaml.safe_load(text)
        except ImportError:
            loaded = json.loads(text)
        if not isinstance(loaded, dict):
            raise ValueError("the root of a settings file must be a mapping")
        out |= loaded
    for item in overrides:
        key, sign, value = item.partition("=")
        if not sign or not key:
            raise ValueError(f"an override must look like a.b=value: {item!r}")
        *parents, last = key.split(".")
        at = out
        for name in parents:
            at = at.setdefault(name, {})
            if not isinstance(at, dict):
                raise ValueError(f"{name} in {key} is not a mapping")
        at[last] = scalar(value)
    return out
