"""Inputs and outputs: source trees, corpus tables, snapshots, report sinks."""
