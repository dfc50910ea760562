"""Invoice and tax analytics as plain DataFrame and Column functions on Spark."""
