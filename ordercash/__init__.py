"""Order-to-cash analytics, entity graphs and text jobs as PySpark DataFrame operators."""
