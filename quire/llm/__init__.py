"""Training-data operators: near duplicates, filtering, decontamination, scoring, packing and sharding."""
