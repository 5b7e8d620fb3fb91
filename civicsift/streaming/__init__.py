"""Structured Streaming: labelling, scoring and masking of arriving texts."""
