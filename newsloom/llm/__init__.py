"""Training-data operators: archives, classifiers, mixing, near-duplicates, tokens, packing, secrets, vectors."""
