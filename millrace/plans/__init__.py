"""All registered queries of the engine and their SQL."""

from . import learning_queries, matrix_queries, model_queries, text_queries, vector_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
