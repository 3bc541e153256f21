"""tessera: record, document and graph analytics as PySpark DataFrame operators."""
