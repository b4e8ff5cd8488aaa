"""Analytics over ordered, per-entity signals and texts, as Spark jobs."""
