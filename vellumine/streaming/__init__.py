"""streaming of vellumine."""
