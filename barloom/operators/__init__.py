"""Operators over long panels, one module per subject."""
