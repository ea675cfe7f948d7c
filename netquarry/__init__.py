"""Analytics of network-device configurations on Spark."""
