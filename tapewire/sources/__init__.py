"""Readers, sinks and the partitioned article store."""
