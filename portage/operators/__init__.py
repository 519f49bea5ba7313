"""Sinks, bulk copies, the run log and the registry."""
