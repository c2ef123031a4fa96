"""Packet and flow analytics expressed as Spark DataFrame plans."""
