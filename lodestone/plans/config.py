"""Settings, their checks and precedence, the model table, retries and errors."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from typing import Any, TypeVar

from ..operators.chunking import ChunkConfig

R = TypeVar("R")


class LodestoneError(RuntimeError):
    """Base of this package's errors."""


class ConfigError(LodestoneError):
    pass


class DiscoveryError(LodestoneError):
    pass


class IndexingError(LodestoneError):
    pass


@dataclass(frozen=True)
class Model:
    name: str
    description: str
    dimensions: int
    size_bytes: int
    backend: str


# Known models with dimensions and bytes.
MODELS = {
    m.name: m
    for m in (
        Model("sentence-transformers/all-MiniLM-L6-v2", "fast and small, for general use", 384, 23_000_000, "fastembed"),
        Model("sentence-transformers/all-MiniLM-L12-v2", "larger and more accurate", 384, 44_000_000, "fastembed"),
        Model("nomic-embed-code.Q5_K_S.gguf", "for code", 768, 2_500_000_000, "gguf"),
        Model("Qwen/Qwen3-Embedding-0.6B", "many languages and code", 1024, 600_000_000, "huggingface"),
    )
}
DEFAULT_MODEL = "sentence-transformers/all-MiniLM-L6-v2"


def model(name: str) -> Model:
    if name not in MODELS:
        raise ConfigError(f"unknown model {name!r}; there are {sorted(MODELS)}")
    return MODELS[name]


@dataclass(frozen=True)
class Settings:
    model: str = DEFAULT_MODEL
    embed_batch: int = 32
    cache_entries: int = 1000
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    max_file_bytes: int | None = None
    respect_gitignore: bool = True
    include_untracked: bool = False
    limit: int = 10
    min_similarity: float = 0.1
    rehydrate: bool = True
    max_glob: int = 1000
    max_extension: int = 10
    index_dir: str = ".lodestone"

    def validate(self) -> Settings:
        problems = [
            f"{name} must be at least 1"
            for name in ("embed_batch", "cache_entries", "limit", "max_glob", "max_extension")
            if getattr(self, name) < 1
        ]
        if self.max_file_bytes is not None and self.max_file_bytes < 1:
            problems.append("max_file_bytes must be at least 1")
        if not 0 <= self.min_similarity <= 1:
            problems.append("min_similarity must be from 0 to 1")
        try:
            self.chunk.validate()
        except ValueError as e:
            problems.append(str(e))
        if problems:
            raise ConfigError("; ".join(problems))
        return self


#: Where a section's key goes.
SECTIONS = {
    "embedding": {"model": "model", "batch_size": "embed_batch", "cache_size": "cache_entries"},
    "indexing": {"max_file_size": "max_file_bytes", "respect_gitignore": "respect_gitignore", "include_untracked": "include_untracked"},
    "search": {"limit": "limit", "min_similarity": "min_similarity", "rehydrate_content": "rehydrate"},
    "directories": {"index": "index_dir"},
    "filtering": {"max_glob_pattern_length": "max_glob", "max_extension_length": "max_extension"},
}
CHUNK_KEYS = {"target_tokens": "target", "overlap_tokens": "overlap", "max_tokens": "most", "min_tokens": "least"}


def merged(*layers: dict[str, Any]) -> Settings:
    """Settings from layers of sections, the first given winning: command line, YAML, JSON, then defaults."""
    out = Settings()
    names = {f.name for f in fields(Settings)}
    for layer in reversed(layers):
        flat: dict[str, Any] = {k: v for k, v in layer.items() if k in names and k != "chunk" and v is not None}
        for section, keys in SECTIONS.items():
            flat |= {keys[k]: v for k, v in (layer.get(section) or {}).items() if k in keys}
        chunk = {CHUNK_KEYS[k]: v for k, v in (layer.get("chunking") or {}).items() if k in CHUNK_KEYS}
        out = replace(out, **flat, chunk=replace(out.chunk, **chunk))
    return out


def effective_model(*choices: str | None) -> str:
    return next((c for c in choices if c), DEFAULT_MODEL)


def check_instruction(name: str, instruction: str | None) -> None:
    if instruction and "qwen3" not in name.lower():
        raise ConfigError(f"{name} takes no instruction")


@dataclass(frozen=True)
class Retry:
    tries: int
    first_s: float
    factor: float = 2.0
    cap_s: float = 30.0
    jitter: float = 0.25

    def delay(self, attempt: int) -> float:
        """Seconds before an attempt, without jitter; none before the first."""
        return 0.0 if attempt <= 0 else min(self.cap_s, self.first_s * self.factor ** (attempt - 1))

    def run(self, act: Callable[[], R], sleep: Callable[[float], None] = time.sleep) -> R:
        for attempt in range(self.tries):
            sleep(self.delay(attempt) * (1 + random.uniform(-self.jitter, self.jitter)))
            try:
                return act()
            except Exception:
                if attempt + 1 == self.tries:
                    raise
        raise ValueError("a retry needs at least one try")


# Tries and first delay by kind of work.
RETRIES = {"network": Retry(3, 0.5), "file": Retry(2, 0.1), "download": Retry(5, 1.0)}
