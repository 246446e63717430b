"""Record linkage and data preparation as declarative Spark plans."""
