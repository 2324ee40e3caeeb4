"""threadloom: Spark operators for customer-conversation data."""
