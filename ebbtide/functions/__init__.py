"""Functions of the recurring-payment engine."""
