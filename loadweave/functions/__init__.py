"""Column expressions: time, calendar, text and schema repair."""
