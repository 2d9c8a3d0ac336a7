"""Operators on DataFrames: upserts, paging, chunking, retrieval, jobs, metrics."""
