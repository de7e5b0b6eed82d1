"""pageloom: web pages and documents as relational data on Spark."""
