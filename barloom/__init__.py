"""barloom: daily-bar screening and corpus preparation as PySpark DataFrame operators."""
