"""Training-data operators: tokenising, deduplication, mixing, classifiers, audits and fingerprints."""
