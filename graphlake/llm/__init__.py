"""Training-data operators: decontamination, language, search, toxicity, tokens, near-dedup, sharding, LM scoring, packing.

Nothing outside this subpackage imports it.
"""
