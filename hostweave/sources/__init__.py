"""Flow log schema, readers and writers."""
