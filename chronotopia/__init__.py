"""Character, place and time encounter analytics as Spark DataFrame plans."""
