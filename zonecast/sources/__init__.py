"""Tables in and out: dimensions, bronze day files, silver tables, bitemporal series, gold features, exports."""
