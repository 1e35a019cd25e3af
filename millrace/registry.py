"""All queries outside `llm` by name, with the SQL that gives the same rows."""

from . import more_queries, page_queries, reader_queries, reading_queries, sql_queries, state_queries, store_queries, text_queries, upkeep_queries  # noqa: F401 - add their queries
from .queries import ORACLE_SQL, QUERIES

FLAGSHIP = "vec_topk"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
