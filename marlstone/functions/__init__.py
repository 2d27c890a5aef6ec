"""Value kinds, comparison of strings, scalar and aggregate functions as Columns."""
