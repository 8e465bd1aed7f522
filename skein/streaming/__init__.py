"""Structured Streaming forms of the incremental operators; each equals its batch form."""
