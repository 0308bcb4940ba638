"""Table-level operators: every function here takes and returns ``DataFrame``."""
