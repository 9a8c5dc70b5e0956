"""Queries and SQL of this subpackage."""

from sessionloom.llm import audio, centroids, decontaminate, language_id, ngram_join, packing, phrases, secret_scan, simhash, substring_dedup, token_store, toxicity, warc

MODULES = (toxicity, token_store, decontaminate, substring_dedup, warc, language_id, secret_scan, packing, ngram_join, audio, simhash, centroids, phrases)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
