"""Structured Streaming versions of the scan, the score and the rate-limit check."""
