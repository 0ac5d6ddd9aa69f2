"""Names and small specification languages, read on the driver."""
