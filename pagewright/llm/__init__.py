"""Training-data operators (dedup, decontamination, classifiers, tokenizing)."""
