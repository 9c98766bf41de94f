"""Panel operators over streams."""
