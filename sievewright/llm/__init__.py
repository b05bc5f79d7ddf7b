"""Training-data operators: deduplication, mixing, tokenisation, filters and nearest neighbours."""
