"""Operators over documents, blocks, notes and anchors."""
