"""Corpus operators for training-data pipelines: mixing, quality, packing, sharding, dedup, search, scoring.

Nothing outside this subpackage imports it. Each module holds one operator with its own
general interface; ``registry`` holds the thin ``opN_*`` queries over the test tables.
"""
