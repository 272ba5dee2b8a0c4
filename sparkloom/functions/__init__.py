"""functions of sparkloom."""
