"""Operators of a training-data pipeline: identity, language, tokens, extraction, privacy, sharding and packing."""

from importlib import import_module

MODULES = (
    "minhash_dedup", "language_id", "chunk_bpe", "html_main_text", "personal_data", "fingerprints", "url_filter", "feistel_shards",
    "digest_index", "packing", "importance_resampling", "repeated_passages", "embedding_whitening",
)


def _registries():
    for module in MODULES:
        yield import_module(f"mnemolake.llm.{module}").registry


def all_queries() -> dict:
    return {name: fn for r in _registries() for name, fn in r.queries.items()}


def all_oracles() -> dict[str, str]:
    return {name: text for r in _registries() for name, text in r.oracle.items()}
