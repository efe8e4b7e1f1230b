"""tokenlake: token streams, n-gram queries and corpus preparation on PySpark."""
