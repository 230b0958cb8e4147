"""Session, usage, event-log and corpus analytics expressed as Spark plans."""
