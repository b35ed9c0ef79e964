"""Column expressions: text normalisation, display forms, chart formulas."""
