"""The two studies' chains of operators."""
