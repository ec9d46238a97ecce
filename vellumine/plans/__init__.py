"""plans of vellumine."""
