"""Settings as frozen dataclasses, read from YAML or JSON; unknown keys are an error."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path
from typing import Any


@dataclasses.dataclass(frozen=True)
class WikiFilter:
    spaces: tuple[str, ...] = ()
    ancestor_ids: tuple[str, ...] = ()
    skip_ancestor_ids: tuple[str, ...] = ()


@dataclasses.dataclass(frozen=True)
class WikiConfig:
    """A wiki's address, who asks, with a password or token, and which pages are wanted."""

    url: str = ""
    user: str = ""
    secret: str = ""
    filter: WikiFilter = WikiFilter()


@dataclasses.dataclass(frozen=True)
class ModelConfig:
    """An HTTP interface of a chat model; none without an address."""

    url: str = ""
    model: str = ""
    key: str = "none"


@dataclasses.dataclass(frozen=True)
class IndexConfig:
    """block_limit: tokens of a block; llm_context: the model's window; chunker and context: 'plain' or 'llm'."""

    block_limit: int = 32000
    llm_context: int = 32768
    chunker: str = "plain"
    context: str = "plain"

    @property
    def safe_limit(self) -> int:
        """With a model as chunker a block and its answer share the window, less 512 tokens for the prompt."""
        return min(self.block_limit, (self.llm_context - 512) // 2) if self.chunker == "llm" else self.block_limit


@dataclasses.dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 10
    prefetch_factor: int = 2
    rrf_k: float = 60.0
    rank_base: int = 0
    window: int = 1
    filter_temperature: float = 0.1
    filter_max_tokens: int = 50
    intent_temperature: float = 0.1


@dataclasses.dataclass(frozen=True)
class Config:
    local_documents: str | None = None
    wiki: WikiConfig = WikiConfig()
    llm: ModelConfig = ModelConfig()
    vision: ModelConfig = ModelConfig()
    dense_url: str = ""
    sparse_url: str = ""
    index: IndexConfig = IndexConfig()
    retrieval: RetrievalConfig = RetrievalConfig()


def build(kind: type, values: dict[str, Any]) -> Any:
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - set(fields)):
        raise ValueError(f"unknown settings for {kind.__name__}: {', '.join(unknown)}")
    out = {}
    for name, value in values.items():
        default = fields[name].default
        out[name] = build(type(default), value) if dataclasses.is_dataclass(default) else tuple(value) if isinstance(value, list) else value
    return kind(**out)


def load_config(path: str) -> Config:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return build(Config, json.loads(text))
    import yaml

    return build(Config, yaml.safe_load(text) or {})
