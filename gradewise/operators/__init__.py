"""DataFrame -> DataFrame operators of the scoring and reporting jobs."""
