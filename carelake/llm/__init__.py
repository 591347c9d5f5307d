"""Training-data operators: one module each, general interfaces, no dependency on the rest of the library."""
