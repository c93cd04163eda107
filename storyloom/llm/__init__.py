"""Training-data operators: mixing, scrubbing, deduplication, scoring, packing, search.

Each module holds one operator with its own general interface; ``queries``
registers the contract queries and their SQL.  Nothing outside this folder
imports it.
"""
