"""Bounded standard input, and SELECTs over micro-batches."""
