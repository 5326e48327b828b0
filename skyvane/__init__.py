"""Weather analytics on Spark: readings, users, activities, alert rules and forecasts."""
