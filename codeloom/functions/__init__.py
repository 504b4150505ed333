"""Column functions: everything here maps columns to columns, inside one row."""
