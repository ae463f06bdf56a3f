"""Token-budgeted retrieval, feedback analytics and corpus preparation as Spark DataFrame transformations."""
