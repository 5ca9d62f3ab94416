"""DataFrame operators. Every one takes and returns DataFrames keyed by conversation, session or project."""
