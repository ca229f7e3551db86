"""The registered queries and, for each, SQL a second engine answers on the same tables."""
