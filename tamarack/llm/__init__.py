"""Training-data operators: ten building blocks for large text corpora."""
