"""Training-data operators: deduplication, quality, toxicity, packing, sharding, encoding, decontamination, chat, WARC."""
