"""Dataflow and iteration building blocks, and the registered queries."""
