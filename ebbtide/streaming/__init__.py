"""Streaming of the recurring-payment engine."""
