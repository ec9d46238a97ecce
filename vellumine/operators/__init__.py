"""operators of vellumine."""
