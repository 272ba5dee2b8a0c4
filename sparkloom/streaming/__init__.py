"""streaming of sparkloom."""
