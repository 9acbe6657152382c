"""Streaming use of the stateless views."""
