"""Transfer specs, the five transfers, and ordered runs of them."""
