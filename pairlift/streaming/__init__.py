"""Window by window, with state between windows."""
