"""Training-data operators: toxicity, near- and exact-dedup, tokenisers,
decontamination, secret scans and sharding, each as a Spark job."""
