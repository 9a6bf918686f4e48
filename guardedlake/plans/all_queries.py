"""Imports every module that registers named queries."""

from guardedlake.plans import (
    answer_queries,
    business_queries,
    corpus_queries,
    guard_queries,
    metric_queries,
    question_queries,
    retrieval_queries,
    routing_queries,
    session_queries,
    stream_queries,
)
from guardedlake.plans.registry import NAMED

__all__ = ["NAMED", "answer_queries", "business_queries", "corpus_queries", "guard_queries", "metric_queries", "question_queries",
           "retrieval_queries", "routing_queries", "session_queries", "stream_queries"]
