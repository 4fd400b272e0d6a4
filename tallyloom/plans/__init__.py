"""Query text, join graph, planning and cardinality estimates."""
