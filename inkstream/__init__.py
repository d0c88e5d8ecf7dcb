"""Content aggregation analytics on Spark: discovery, extraction, dedupe, tagging, matching, delivery."""
