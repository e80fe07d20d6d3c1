"""pricewright: price and marketplace analytics as Spark DataFrame jobs."""
