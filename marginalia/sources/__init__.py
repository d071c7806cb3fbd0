"""Readers of raw inputs and adapters from flat tables to the document and note model."""
