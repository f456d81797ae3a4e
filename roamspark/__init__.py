"""roamspark: Wi-Fi log mobility analytics as DataFrame transformations."""
