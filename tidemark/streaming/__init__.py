"""Structured Streaming pipelines, and their batch forms."""
