"""Key/value command-log analytics expressed as Spark queries."""
