"""DataFrame operators. All are lazy; none collects data to the driver."""
