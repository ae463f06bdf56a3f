"""Training-data operators: one module per operator, queries() and oracle_sql() in queries.py."""
