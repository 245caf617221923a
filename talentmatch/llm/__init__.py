"""Training-data operators: near-dedup, chat formatting, search, tokenizing,
packing, toxicity, sharding and secret scans."""
