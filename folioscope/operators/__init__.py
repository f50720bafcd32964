"""DataFrame operators: order statistics, preprocessing, splits, metrics, neighbours, models."""
