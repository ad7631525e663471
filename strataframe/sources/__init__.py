"""Readers, admission checks, sinks, and domain views over the supplied tables."""
