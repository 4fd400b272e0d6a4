"""Scripts of query batches read from a stream of lines."""
