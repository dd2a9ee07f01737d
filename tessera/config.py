"""Options of a scan. The defaults are part of the semantics."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass
class Config:
    min_tokens: int = 40
    tau_semantic: float = 0.83
    overlap_threshold: float = 0.75
    edit_density_threshold: float = 0.25
    num_hashes: int = 128
    num_bands: int = 16
    shingle_size: int = 5
    max_candidates: int = 50
    max_matches_per_block: int = 5
    min_refactor_score: float = 200.0
    supported_languages: list = field(default_factory=lambda: ["python", "typescript", "javascript"])
    ignore_patterns: list = field(default_factory=lambda: ["node_modules/", ".git/", "dist/", "build/", "*.min.js", "*.pyc", "__pycache__/", ".venv/"])
    cache_dir: str | None = None
    models_dir: str | None = None

    def __post_init__(self):
        if self.num_bands < 1 or self.num_hashes % self.num_bands:
            raise ValueError("num_hashes must be a multiple of num_bands")

    @classmethod
    def load(cls, path) -> "Config":
        return cls(**json.loads(Path(path).read_text()))

    def save(self, path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=2))
