"""Column functions: text and identity, number and value parsers, web addresses, display formats."""
