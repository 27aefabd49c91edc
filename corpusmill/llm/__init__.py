"""Training-data operators: scoring, filtering, deduplication, search, mixing.

Nothing outside this folder imports it; see ``registry`` for the queries.
"""
