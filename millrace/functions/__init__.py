"""Column functions: Column in, Column out; nothing here reads data."""
