"""functions of vellumine."""
