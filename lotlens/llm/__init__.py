"""Training-data operators: dedup, decontamination, extraction, scoring, encoding."""
