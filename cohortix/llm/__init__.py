"""Training-data operators: dedup, similarity joins, tokenisation, packing,
language identification, HTML extraction, URL filters and exact search.

Nothing else in the library imports this subpackage; ``registry`` holds its
queries and their SQL.
"""
