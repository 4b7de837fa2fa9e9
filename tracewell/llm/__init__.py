"""Training-data operators: deduplication, decontamination, classifiers, scoring, search, mixing and token files."""
