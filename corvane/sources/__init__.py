"""Tables and files as DataFrames, and keyed sinks."""
