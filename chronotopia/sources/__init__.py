"""Readers, writers and injected inputs."""
