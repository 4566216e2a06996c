"""Training-data operators: dedup, sharding, personal data, extraction, search, encoding, quality, packing, language."""
