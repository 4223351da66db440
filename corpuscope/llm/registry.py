"""Queries over the given tables, one for each operator, and their SQL."""

from corpuscope.llm import (
    chat_queries, decontaminate_queries, html_extract_queries, maxent_queries, ngram_join_queries, packing_queries, pii_queries, quality_queries,
    reshard_queries, sentence_spans_queries, spelling_queries, token_links_queries, topk_queries,
)

MODULES = [
    pii_queries, maxent_queries, quality_queries, decontaminate_queries, sentence_spans_queries, packing_queries,
    reshard_queries, topk_queries, chat_queries, ngram_join_queries, spelling_queries, html_extract_queries, token_links_queries,
]


def queries():
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracles():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
