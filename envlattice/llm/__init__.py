"""Training-data operators: mixing, quality, tokens, secrets, duplicates, URLs and archives."""
