"""Training-data operators: sharding, decontamination, deduplication, PII, token counts, LM scoring, rules, BPE."""
