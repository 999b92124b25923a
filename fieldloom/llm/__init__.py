"""Operators for preparing training data: token counts, packing, fingerprints, mixing,
substring and near-duplicate removal, sharding, quality, embeddings and scoring.

Nothing else in the library imports this subpackage.
"""
