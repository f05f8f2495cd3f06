"""huntframe: security-log and traffic detection as Spark jobs."""
