"""Operators of the recurring-payment engine."""
