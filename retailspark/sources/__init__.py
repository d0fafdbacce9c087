"""Readers, sinks and stand-in inputs."""
