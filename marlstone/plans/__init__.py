"""From syntax trees to DataFrames, and scripts."""
