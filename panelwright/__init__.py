"""Panel analytics over daily (symbol, date) tables, expressed as Spark DataFrame plans."""
