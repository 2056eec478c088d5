"""Training-data operators: mixing, deduplication, toxicity, chat formatting, packing, PII, embedding search."""
