"""Training-data operators: tokenisation, deduplication, filtering, mixing, archives and chat formatting."""
