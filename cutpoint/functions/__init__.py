"""Column expressions: dates, rounding, two-sample statistics and rule ladders."""
