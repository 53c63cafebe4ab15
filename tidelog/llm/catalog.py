"""The corpus operators' queries, one per operator, and their SQL where SQL can say it."""

from tidelog.llm import chat_format, digests, embedding_dedup, html_text, line_dedup, merkle, mixing, packing, periodic_runs, quality, sharding, simhash, token_counts

_MODULES = (chat_format, simhash, html_text, packing, sharding, mixing, quality, line_dedup, embedding_dedup, digests, periodic_runs, token_counts, merkle)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
