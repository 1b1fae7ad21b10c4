"""Training-data operators. Optional: nothing else in lodestone imports this package."""
