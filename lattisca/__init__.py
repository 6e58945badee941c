"""Analytics over collections of attributed graphs, on Spark."""
