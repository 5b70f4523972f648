"""Operators: DataFrame in, DataFrame out. Every key holds the partition column P (review_id or snapshot_id)."""
