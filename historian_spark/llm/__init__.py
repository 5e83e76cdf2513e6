"""Training-data operators: search, filters, fingerprints, tokens, packing and scans."""
