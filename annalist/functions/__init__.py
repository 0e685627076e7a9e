"""Column builders and scalar functions over names, dates and free text."""
