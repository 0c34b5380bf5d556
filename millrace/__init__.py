"""A typed query engine on PySpark: schemas, fluent queries, joins, search, views and live queries over DataFrames."""
