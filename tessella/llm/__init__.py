"""Training-data operators: deduplication, scoring, sharding, mixing, archives, packing.

Nothing else in the library imports this subpackage. Every module holds one operator with a general
interface; `queries` derives the registered `opN_*` queries from them.
"""
