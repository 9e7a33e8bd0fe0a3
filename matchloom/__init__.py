"""matchloom: record resolution and corpus preparation as Spark DataFrame transformations."""
