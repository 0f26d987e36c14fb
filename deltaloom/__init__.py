"""Schema-change analytics and data-processing operators on PySpark."""
