"""Training-data operators: near and exact dedup, PII, WARC, decontamination, licences, toxicity, BPE."""
