"""Sources of the recurring-payment engine."""
