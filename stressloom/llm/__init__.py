"""Training-data operators: deduplication, classifiers, formatting, decontamination and mixing."""
