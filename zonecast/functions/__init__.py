"""Column expressions: calendar, numeric helpers, loss and score formulas."""
