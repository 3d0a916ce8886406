"""scholia: evidence retrieval and review analytics as PySpark DataFrame plans."""
