"""The row-wise rules over a stream of landed comments."""
