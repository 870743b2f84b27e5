"""Training-data operators (token counts, deduplication, filters, search, extraction) on Spark."""
