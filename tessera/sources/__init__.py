"""sources of the record-linkage engine."""
