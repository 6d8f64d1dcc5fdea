"""Readers, writers and bindings of the available tables to the engine schemas."""
