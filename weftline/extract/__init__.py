"""SQL text to graph rows, on the executors."""
