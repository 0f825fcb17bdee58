"""Parameters of the engine, with defaults; a JSON document or a mapping may override them."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    embedding_dim: int = 1024
    rating_threshold: int = 3
    recent_default_limit: int = 120
    max_limit: int = 100_000
    tag_limit: int = 20
    probability_threshold: float = 0.1
    nprobe: int = 32
    probe_recall: float = 0.95
    probe_queries: int = 256
    train_rows: int = 200_000
    gap_threshold: int = 400
    probe_step: int = 200
    probe_limit: int = 1
    page_size: int = 200
    roll_max_rows: int = 50_000
    roll_max_mib: int = 512
    max_failures: int = 5000
    post_base: str = "https://posts.example.org"
    media_base: str = "https://media.example.org"
    incoming_glob: str = "incoming/*.parquet"
    snapshot_dir: str = "snapshot"
    state_path: str = "state.json"


def load_config(path: str | None = None, base: Config | None = None, environ: dict | None = None) -> Config:
    """File values over environment values over defaults; relative paths count from the file's folder."""
    base = base or Config()
    environ = dict(os.environ) if environ is None else environ
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    found = {k: kinds[k](environ[name]) for k in kinds if (name := f"TESSERA_{k.upper()}") in environ}
    if path and Path(path).exists():
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        found |= {k: kinds[k](v) for k, v in raw.items() if k in kinds and v is not None}
        for k in ("incoming_glob", "snapshot_dir", "state_path"):
            if k in found and not Path(found[k]).is_absolute() and "://" not in found[k]:
                found[k] = str(Path(path).parent / found[k])
    return replace(base, **found)


def clamp_page(limit: int, offset: int, config: Config | None = None) -> tuple[int, int]:
    return max(1, min(int(limit), (config or Config()).max_limit)), max(0, int(offset))
