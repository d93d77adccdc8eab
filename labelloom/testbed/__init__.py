"""Views over the driver's tables in the shape of the engine's inputs, with queries and their SQL."""
