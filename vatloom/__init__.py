"""vatloom: invoice and receipt analytics as PySpark DataFrame plans."""
