"""Log and trip analytics as lazy PySpark DataFrame operators."""
