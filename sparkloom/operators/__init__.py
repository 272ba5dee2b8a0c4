"""operators of sparkloom."""
