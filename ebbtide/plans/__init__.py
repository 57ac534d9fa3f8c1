"""Plans of the recurring-payment engine."""
