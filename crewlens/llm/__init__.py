"""Operators a training-data pipeline needs: language id, near-dedup, decontamination,
PII, secrets, LM scoring, sharding, packing and token files.

Nothing outside this subpackage imports it.
"""
