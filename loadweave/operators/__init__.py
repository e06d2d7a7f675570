"""DataFrame operators: deduplication, windows, reshape, quality, alignment, features."""
