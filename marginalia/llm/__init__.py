"""Training-data operators: dedup, filters, decontamination and mixing."""
