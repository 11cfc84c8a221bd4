"""The registered queries of the operators and their SQL."""

from fraygraph.llm import (  # noqa: F401
    chat, chunk_dedup, decontaminate, importance, jaccard, language_id, licences, mixing, personal, quality, ranked_search, token_counts, token_output,
)
from fraygraph.llm.tables import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
