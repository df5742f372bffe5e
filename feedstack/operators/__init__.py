"""DataFrame -> DataFrame operators of the review model."""
