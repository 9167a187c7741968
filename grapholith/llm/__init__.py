"""Training-data operators: search, tokenisation, deduplication, filtering and packing.

Nothing outside this subpackage imports it. Each module holds one operator; the
registered queries and their SQL are in :mod:`grapholith.llm.queries`.
"""
