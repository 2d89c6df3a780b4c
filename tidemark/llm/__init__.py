"""Training-data operators: deduplication, search, PII, language, packing, tokens, sharding, quality."""
