"""Streaming forms of the temporal operators (an extension: the batch forms define the results)."""
