"""Training-data operators: deduplication, fingerprints, packing, mixing, formatting, extraction, classification, URL judgement.

Nothing outside this subpackage imports it.
"""
