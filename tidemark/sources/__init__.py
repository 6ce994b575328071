"""Tables, role views and sinks."""
