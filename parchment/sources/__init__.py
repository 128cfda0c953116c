"""Files in, reports and documents out."""
