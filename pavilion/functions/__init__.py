"""Column functions: no rows are looked at here, only expressions are built."""
