"""Structured Streaming over the append-only history: an extension, not something the batch service had."""
