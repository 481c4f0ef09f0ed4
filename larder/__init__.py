"""larder: retail-catalogue and recipe-costing analytics as Spark DataFrame jobs."""
