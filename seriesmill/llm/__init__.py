"""Text operators for building training data; nothing else in seriesmill imports this subpackage."""
