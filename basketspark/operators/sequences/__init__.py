"""Sequential pattern mining over customers' baskets."""
