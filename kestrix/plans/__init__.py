"""Query families over the test tables: a DataFrame builder and its SQL side by side."""
