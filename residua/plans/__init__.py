"""Specification, planning and execution of an embedding run; the command line."""
