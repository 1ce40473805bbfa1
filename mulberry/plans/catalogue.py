"""All query modules of the core."""

from mulberry.plans import bank_queries, gold_queries, learner_queries, retrieval_queries, text_queries

MODULES = [text_queries, retrieval_queries, learner_queries, bank_queries, gold_queries]
