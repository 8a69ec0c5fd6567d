"""operators of the record-linkage engine."""
