"""Text retrieval on Spark: tokens, postings, Boolean and ranked queries over whole workloads."""
