"""Training-data operators: ten corpus jobs and the queries that apply them.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own general interface; ``queries`` registers the thin
contract queries and their SQL; ``corpus_pipeline`` (repository top) chains
five of the operators.
"""
