"""Training-data operators: fingerprints, quality, packing, URL reputation, toxicity,
near-duplicates of vectors and texts, pseudonyms, repeated passages, tokenisation.

Nothing else in the library imports this package."""
