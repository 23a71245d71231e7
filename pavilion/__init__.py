"""Match and scorecard analytics, expressed as Spark DataFrame jobs."""
