"""Operators and queries for training-data pipelines (language ID, packing,
toxicity, near-duplicate joins, URL filters, substring dedup, decontamination,
exact top-k, licence scans, chat repair).  Nothing else in the library imports
this subpackage."""
