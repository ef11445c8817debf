"""Following a change log as a stream."""
