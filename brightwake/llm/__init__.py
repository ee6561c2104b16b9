"""Training-data operators: filtering, dedup, mixing, tokenising and packing.

Nothing outside this subpackage imports it.
"""
