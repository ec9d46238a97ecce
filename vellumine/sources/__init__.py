"""sources of vellumine."""
