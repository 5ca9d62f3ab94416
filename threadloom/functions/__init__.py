"""Column expressions and the few physical helpers (numbering, top-k, lineage cuts) operators share."""
