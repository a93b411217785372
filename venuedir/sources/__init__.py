"""Reading catalogue inputs and writing catalogue tables."""
