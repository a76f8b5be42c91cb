"""A Spark-native analytics engine: an SQL front end, a DataFrame API and a function library over Catalyst plans."""
