"""groundq: grounded quotation analytics as Spark DataFrame transformations."""
