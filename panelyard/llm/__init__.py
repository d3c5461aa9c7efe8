"""Training-data operators: near-duplicates, tokens, language, personal data, mixing."""
