"""Training-data operators: filtering, deduplication, tokenisation, mixing and packing.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
