"""State over sequences of validation scores, in batches and streams."""
