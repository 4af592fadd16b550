"""Training-data operators: quality, language, near duplicates, mixing, tokens."""
