"""Tunables of the engine, with environment overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

ENV_PREFIX = "MARGINALIA_"


@dataclass(frozen=True)
class Settings:
    max_file_size: int = 50 * 1024 * 1024
    top_k: int = 12
    min_similarity: float = 0.35
    chunk_max_words: int = 180
    chunk_overlap_words: int = 30
    ocr_engine: str = "auto"
    ocr_languages: str = "eng"
    ocr_batch_size: int = 8
    ocr_dpi: int = 300
    ocr_min_chars_per_page: int = 40
    summarize_with_model: bool = True
    chat_model: str = "gemma3:1b"
    embed_model: str = "nomic-embed-text"
    model_base_url: str = "http://localhost:11434"
    #: Most queries of a batch that one scan of the corpus answers; larger batches use more scans.
    queries_per_scan: int = 4096

    @classmethod
    def from_env(cls) -> Settings:
        """Defaults overridden by ``MARGINALIA_<FIELD>`` variables."""
        found = {}
        for field in fields(cls):
            raw = os.environ.get(ENV_PREFIX + field.name.upper())
            if raw is None:
                continue
            if field.type == "bool":
                found[field.name] = raw not in {"0", "false", "False"}
            elif field.type in {"int", "float"}:
                found[field.name] = {"int": int, "float": float}[field.type](raw)
            else:
                found[field.name] = raw
        return cls(**found)


DEFAULTS = Settings()
