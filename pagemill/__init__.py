"""Document-to-quiz analytics as declarative Spark plans."""
