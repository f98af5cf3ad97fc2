"""Clinical event and market panel analytics as Spark DataFrame plans."""
