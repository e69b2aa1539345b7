"""Structured Streaming forms; on complete input each equals its batch operator."""
