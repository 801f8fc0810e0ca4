"""Column expressions: text normal forms, slugs, headings, numerals."""
