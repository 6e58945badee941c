"""Training-data operators: sharding, token files, language, near-duplicates, WARC, HTML, toxicity, quality, contamination, packing."""
