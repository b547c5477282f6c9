"""tessera: data mining and analytics as Spark DataFrame plans."""
