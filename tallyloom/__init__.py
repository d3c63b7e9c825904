"""tallyloom: evaluation analytics and training-data curation on PySpark."""
