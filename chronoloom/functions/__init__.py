"""Column functions: everything here maps columns to columns inside Catalyst."""
