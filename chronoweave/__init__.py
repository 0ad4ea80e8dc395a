"""Event-to-signal synchronisation and relational analytics on Spark DataFrames."""
