"""Plans: inputs and settings to lazy DataFrames."""
