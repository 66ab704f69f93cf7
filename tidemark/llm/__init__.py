"""Training-data pipeline operators.  Nothing outside this package imports it, except ``__spark_entry__`` under a guard."""
