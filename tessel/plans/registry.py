"""All queries of the library and their SQL, by name."""

from tessel.plans import analytics, compound_models, corpus_sequences, dependence_rankings, fits, learned_structure, models, rank_tests, sequence_models, structure_models, survival_evaluation, topic_models  # noqa: F401
from tessel.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
