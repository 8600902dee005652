"""Training-data operators: each module holds one operator with its general interface; queries.py holds the thin registered queries."""
