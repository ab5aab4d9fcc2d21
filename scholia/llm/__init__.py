"""Training-data operators: near-duplicates, packing, licences, language, search, mixing, PII, quality, HTML."""
