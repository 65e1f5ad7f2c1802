"""Settings and prompts: read once by the driver, from JSON or, where its parser is installed, YAML."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields


@dataclass(frozen=True)
class Settings:
    """What a study fixes; unknown names are refused."""

    window: int = 510
    overlap: int = 128
    seed: int = 42
    ratios: dict[str, float] = field(default_factory=lambda: {"train": 0.64, "validation": 0.16, "test": 0.20})
    labels: tuple[str, ...] = ("USCIS", "DMV", "SSA", "IRS")
    prompt: str = "Classify the document into one of {labels}.\n{context}\nDocument:\n{document}"

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.window:
            raise ValueError("overlap must be less than window")
        if abs(sum(self.ratios.values()) - 1) > 1e-9:
            raise ValueError("ratios must sum to 1")

    def digest(self) -> str:
        """The same for equal settings, in whatever order they were written."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def _parse(text: str) -> dict:
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        import yaml

        return yaml.safe_load(text) or {}


def settings(text: str) -> Settings:
    given = _parse(text)
    if unknown := set(given) - {f.name for f in fields(Settings)}:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    if "labels" in given:
        given["labels"] = tuple(given["labels"])
    return Settings(**given)


def prompt(text: str, placeholders: tuple[str, ...] = ("document",)) -> tuple[str, str]:
    """(template, its SHA-256) of a prompt file with the key template; it must have the placeholders."""
    template = _parse(text)["template"]
    if missing := [p for p in placeholders if "{" + p + "}" not in template]:
        raise ValueError(f"the prompt lacks {missing}")
    return template, hashlib.sha256(template.encode()).hexdigest()
