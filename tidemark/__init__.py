"""tidemark: point-in-time churn analytics written as Spark plans."""
