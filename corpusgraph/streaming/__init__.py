"""Structured Streaming over arriving papers and logs."""
