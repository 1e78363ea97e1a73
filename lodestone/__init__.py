"""Hybrid retrieval over document collections, as Spark plans."""

from .functions.embed import hash_embed, hashing_embedding, model_embedding
from .functions.vectors import cosine_similarity, l2_to_cosine, minmax
from .operators.chunker import chunk_documents
from .operators.fulltext import bm25, bm25_topk, fts_match, postings, write_postings
from .operators.hybrid import hybrid_search, inject_context, query_json
from .operators.index_state import index_stats, is_stale
from .operators.vector_search import knn
from .plans.config import Config, load_config, save_config
from .plans.engine import Engine
from .plans.store import Store
from .sources.collect import collect_files, collect_tracked
from .sources.extract import extract_files, html_to_markdown

__all__ = [
    "Config", "Engine", "Store", "bm25", "bm25_topk", "chunk_documents", "collect_files", "collect_tracked", "cosine_similarity",
    "extract_files", "fts_match", "hash_embed", "hashing_embedding", "html_to_markdown", "hybrid_search", "index_stats", "inject_context",
    "is_stale", "knn", "l2_to_cosine", "load_config", "minmax", "model_embedding", "postings", "query_json", "save_config", "write_postings",
]
