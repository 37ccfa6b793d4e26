"""Training-data operators: fingerprints, classifiers, language model, tokenizer, deduplication and sharding.

Nothing else in the library imports this subpackage.
"""
