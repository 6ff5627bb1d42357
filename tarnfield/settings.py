"""Settings: explicit values before environment (``TARNFIELD_<NAME>``) before a YAML file before defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    base_url: str = "https://example.com/help"
    book_root: str = "help"
    fence: str = "code"  # language mark of code fences
    script_name: str = ""  # name of the scripting language, a word that makes a question one about scripting
    script_books: tuple[str, ...] = ()  # books that a scripting question prefers
    sample_extension: str = ".csv"
    chunk_size: int = 1200
    chunk_overlap: int = 200
    min_page_chars: int = 200
    k_per_query: int = 20
    k_final: int = 6
    rerank_candidates: int = 24
    rerank_max_chars: int = 800
    weight_dense: float = 0.6
    weight_bm25: float = 0.4
    page_type_boost: float = 0.15
    cosine_floor: float = 0.45
    rerank_floor: float = -4.0
    retry_bonus: int = 3
    query_cap: int = 4
    max_context_chars: int = 5000
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25

    @staticmethod
    def load(path: str | None = None, **given) -> "Settings":
        values: dict = {}
        if path and os.path.exists(path):
            import yaml

            with open(path, encoding="utf-8") as f:
                values |= yaml.safe_load(f) or {}
        kinds = {f.name: type(f.default) for f in fields(Settings)}
        for name, kind in kinds.items():
            if (told := os.environ.get(f"TARNFIELD_{name.upper()}")) is not None:
                values[name] = tuple(told.split(",")) if kind is tuple else kind(told)
        values |= given
        if unknown := set(values) - set(kinds):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return Settings(**{k: tuple(v) if kinds[k] is tuple else v for k, v in values.items()})
