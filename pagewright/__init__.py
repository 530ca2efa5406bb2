"""pagewright: long-document analytics expressed as Spark plans."""
