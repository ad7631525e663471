"""Training-data operators: language, toxicity, deduplication, decontamination, packing, sharding."""
