"""Training-data operators: decontamination, scans, dedup, quality, sharding and mixing."""
