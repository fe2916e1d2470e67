"""Training-data operators: sharding, deduplication, quality, mixing, decontamination, licences, token output."""
