"""Structured Streaming operators; each has a batch twin in ``fleetlens.operators``."""
